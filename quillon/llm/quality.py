"""Quality rules with host-level verdicts (built-in DataFrame functions only).

Each document is measured, rule failures are summed by host, every host's rate is shrunk towards an empirical
beta prior, and the hosts' verdicts are joined back to the documents: a host whose shrunk rate of some rule is above
the limit is rejected with all its documents; a host whose shrunk rate stands out from the prior by more than WATCH of
its deviations is watched, and its documents that fail that rule go too (elsewhere only the base rule decides).

Defined cases: a null or empty text has no words and fails the base rule; a null host is a host of its own;
repeated rows count as often as they occur; an empty table gives an empty result; columns other than the id,
text and host are not read, so clashing names in them do no harm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAKS, let, staged

SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A host is rejected when its shrunk rate of a rule's failures is above this.
HOST_LIMITS = {"base": 0.5, "symbols": 0.5, "lines": 0.5}
WATCH = 1.0


def _without(text: Column, chars: str) -> Column:
    return reduce(lambda c, ch: F.replace(c, F.lit(ch), F.lit("")), chars, text)


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included.

    Windows are compared by a 64-bit hash of their words' hashes. Only texts in which a hash repeats pay for sorting.
    """

    def covered(pairs: Column) -> Column:
        def fold(n: Column) -> Column:
            repeated = F.filter(
                pairs,
                lambda x, i: ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(pairs, i + 1)["h"] == x["h"])),
            )
            at = F.sort_array(F.transform(repeated, lambda x: x["p"]))
            start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            step = lambda s, p: F.struct(p.alias("last"), (s["n"] + F.least(F.lit(WINDOW), p - s["last"])).alias("n"))
            return F.aggregate(at, start, step, lambda s: s["n"])

        return let(F.size(pairs), fold)

    def from_hashes(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

        def decide(w: Column) -> Column:
            pairs = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(pairs, covered))

        return let(windows, decide)

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), from_hashes))


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all long) of a text; null counts as empty."""
    has_word = lambda line: F.length(_without(line, WORD_BREAKS)) > 0

    def body(t: Column) -> Column:
        words = F.filter(F.split(F.translate(t, WORD_BREAKS[1:], " " * 5), " "), lambda w: w != "")

        def of_words(ws: Column) -> Column:
            lines = F.filter(F.split(t, "\n"), has_word)
            return F.struct(
                F.size(ws).cast("long").alias("n_words"),
                F.length(_without(t, WORD_BREAKS)).cast("long").alias("word_chars"),
                (F.octet_length(t) - F.octet_length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
                let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                _repeat_words(ws).cast("long").alias("n_repeat_words"),
            )

        return let(words, of_words)

    return let(F.coalesce(text, F.lit("")), body)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def rule_failures() -> dict[str, Column]:
    """The rules whose failures are summed by host."""
    return {
        "base": base_failed(),
        "symbols": F.col("n_symbols") * 10 > F.col("word_chars"),
        "lines": F.col("n_dup_lines") * 10 > F.col("n_words"),
    }


def measured(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with the measures as one struct column `measures__`."""
    return docs.withColumn("measures__", measures(F.col(text)))


def host_verdicts(measured_docs: DataFrame, host: str = "host", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """One row per host: documents, each rule's raw and shrunk failure rate, whether the rule is watched, and `rejected`.

    Rates are taken as draws from a beta distribution whose mean and strength are fitted by moments over the hosts
    (weighted by documents); a host's shrunk rate is (failures + a) / (documents + a + b). All steps are partial
    aggregations and one row of prior parameters, so a host with a third of all rows costs no more than another.
    """
    rules = rule_failures()
    flags = measured_docs.select(F.col(host).alias("host"), *[c.cast("long").alias(f"f_{k}") for k, c in rules.items()])
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"f_{k}").alias(f"f_{k}") for k in rules])
    prior = hosts.agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("docs2"),
        F.count(F.lit(1)).alias("hosts"),
        *[F.sum(f"f_{k}").alias(f"s_{k}") for k in rules],
        *[F.sum(F.col(f"f_{k}").cast("double") * F.col(f"f_{k}") / F.col("n")).alias(f"q_{k}") for k in rules],
    )
    out = hosts.crossJoin(F.broadcast(prior))  # one row of totals
    for k in rules:
        mean = (F.col(f"s_{k}") + 0.5) / (F.col("docs") + 1.0)
        spread = F.col(f"q_{k}") - F.col(f"s_{k}").cast("double") * F.col(f"s_{k}") / F.col("docs")
        scale = F.col("docs") - F.col("docs2") / F.col("docs")
        # Between-host variance by moments, kept inside the range that a beta distribution can have.
        between = F.coalesce(F.try_divide(spread - (F.col("hosts") - 1) * mean * (1 - mean), scale), F.lit(0.0))
        between = F.greatest(between, mean * (1 - mean) / 1000.0)
        strength = F.greatest(mean * (1 - mean) / between - 1.0, F.lit(1.0))
        out = out.withColumn(f"rate_{k}", F.col(f"f_{k}") / F.col("n")).withColumn(
            f"shrunk_{k}", (F.col(f"f_{k}") + mean * strength) / (F.col("n") + strength)
        )
        out = out.withColumn(f"watched_{k}", F.col(f"shrunk_{k}") > mean + WATCH * F.sqrt(between))
    over = reduce(lambda a, b: a | b, [F.col(f"shrunk_{k}") > v for k, v in limits.items()])
    return out.select("host", "n", *[f"rate_{k}" for k in rules], *[f"shrunk_{k}" for k in rules], *[f"watched_{k}" for k in rules], over.alias("rejected"))


def judged(rows: DataFrame, *, host: str = "source", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """rows that hold the measures' columns, with base_failed and kept.

    Only rejected and watched hosts are joined back; Spark broadcasts them where their measured size allows and
    otherwise shuffles, splitting a hot host.
    """
    rules = rule_failures()
    watched = [f"watched_{k}" for k in rules]
    bad = host_verdicts(rows, host, limits).where(reduce(lambda a, b: a | b, [F.col(c) for c in ("rejected", *watched)]))
    bad = bad.select(F.col("host").alias("bad_host__"), F.col("rejected").alias("rejected__"), *[F.col(c).alias(f"{c}__") for c in watched])
    joined = rows.join(bad, rows[host].eqNullSafe(bad["bad_host__"]), "left")
    fails = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"watched_{k}__"), F.lit(False)) & F.coalesce(c, F.lit(False)) for k, c in rules.items()])
    kept = ~F.col("base_failed") & ~F.coalesce("rejected__", F.lit(False)) & ~fails
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", kept).drop("bad_host__", "rejected__", *[f"{c}__" for c in watched])


def quality_rules(docs: DataFrame, *, id: str = "doc_id", text: str = "text", host: str = "source", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """Per document: the measures, base_failed and kept. The measures are written once to the shared folder."""
    rows = docs.select(F.col(id).alias("doc_id"), F.col(host).alias("host__"), measures(F.col(text)).alias("m")).select("doc_id", "host__", "m.*")
    return judged(staged(rows, "quality"), host="host__", limits=limits).drop("host__")


def filter_quality(docs: DataFrame, *, text: str = "text", host: str = "source", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """The rows of docs that are kept, with docs' own columns; documents are not shuffled unless many hosts are rejected.

    The measures are computed once and written with the rows; texts that fail the base rule are not written with them.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}__" for i in range(len(columns))])
    own = dict(zip(columns, plain.columns, strict=True))
    rows = plain.withColumn("m__", measures(F.col(own[text]))).select("*", "m__.*").drop("m__")
    rows = staged(rows.withColumn(own[text], F.when(~base_failed(), F.col(own[text]))), "quality")
    return judged(rows, host=own[host], limits=limits).where("kept").select(*plain.columns).toDF(*columns)
