"""Duplicate audits, near-duplicate graphs, grouped folds and data-quality constraints."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import count_if, draw, hamming
from ..sources.shared import shared_folder
from .relational import numbered_groups
from .windows import numbered, with_group


def audit_duplicates(df: DataFrame, *, hash: str = "sha256_hash", class_: str = "class_label") -> DataFrame:
    """Rows whose hash occurs more than once: size, number by sorted hash, and whether classes are mixed."""
    g = df.where(F.col(hash).isNotNull()).groupBy(hash).agg(F.count(F.lit(1)).alias("size"), (F.countDistinct(class_) > 1).alias("is_cross_class")).where("size > 1")
    return df.join(numbered_groups(g, hash), hash)


def resolve_duplicates(df: DataFrame, *, hash: str = "sha256_hash", id: str = "filepath") -> DataFrame:
    """keep_for_training: true for the least id of each hash."""
    return with_group(df, [hash], first__=F.min(id)).withColumn("keep_for_training", F.col(id) == F.col("first__")).drop("first__")


def _slices(bits: int, parts: int) -> list[tuple[int, int]]:
    """Start and width of `parts` slices of nearly equal width."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def slicing(n: int, threshold: int, bits: int = 64) -> tuple[int, int]:
    """How many slices a code is cut into and how many bits may differ in one, for n codes.

    Of m slices one differs in at most threshold // m bits. Fewer, wider slices meet fewer codes by chance but have more
    neighbours to look up; the choice has the least lookups and chance meetings together.
    """
    best = None
    for near in range(4):
        m = threshold // (near + 1) + 1
        lookups = sum(sum(math.comb(w, k) for k in range(near + 1)) for _, w in _slices(bits, m))
        meetings = sum(n * n * sum(math.comb(w, k) for k in range(near + 1)) / 2.0**w for _, w in _slices(bits, m))
        cost = n * lookups + meetings
        if best is None or cost < best[0]:
            best = (cost, m, near)
    return best[1], best[2]


def _cut(df: DataFrame, code: str, parts: int, near: int) -> DataFrame:
    """code, band, value: each slice of each code, with all values up to `near` bits away."""
    rows = []
    for band, (start, width) in enumerate(_slices(64, parts)):
        masks = [sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(width), k)]
        value = F.shiftrightunsigned(F.col(code), start).bitwiseAND(F.lit((1 << width) - 1).cast("long")) if width < 64 else F.col(code)
        rows.append(F.struct(F.lit(band).alias("band"), value.alias("value"), F.array(*[F.lit(m).cast("long") for m in masks]).alias("masks")))
    each = df.select(code, F.explode(F.array(*rows)).alias("s")).select(code, "s.band", "s.value", F.explode("s.masks").alias("mask"))
    return each.select(code, "band", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))


def hamming_pairs(left: DataFrame, right: DataFrame, threshold: int, *, id: str = "id", code: str = "code", self_join: bool = True) -> DataFrame:
    """(a, b, distance) of all pairs of codes within a Hamming threshold, exactly: an equi-join on slices, then the test.

    One side looks up its slices with all values a few bits away; how wide slices are follows from the number of
    distinct codes (see slicing). Ids of equal codes meet through their code, so many copies of one code cost their
    distinct code once.
    """
    l = left.select(F.col(id).alias("a"), F.col(code).alias("ca"))
    r = right.select(F.col(id).alias("b"), F.col(code).alias("cb"))
    ours, theirs = l.select("ca").distinct(), r.select("cb").distinct()
    parts, near = slicing(max(1, theirs.count()), threshold)
    codes = _cut(ours, "ca", parts, near).join(_cut(theirs, "cb", parts, 0), ["band", "value"]).where(hamming(F.col("ca"), F.col("cb")) <= threshold).select("ca", "cb").distinct()
    pairs = codes.join(l, "ca").join(r, "cb").select("a", "b", hamming(F.col("ca"), F.col("cb")).alias("distance"))
    return pairs.where("a < b") if self_join else pairs


def either_pairs(left: DataFrame, right: DataFrame, thresholds: dict[str, int], *, id: str = "id", self_join: bool = True) -> DataFrame:
    """(a, b, and the distance of each code) of pairs that are within the threshold of at least one of several codes."""
    names = list(thresholds)
    found = None
    for c in names:
        some = hamming_pairs(left, right, thresholds[c], id=id, code=c, self_join=self_join).select("a", "b")
        found = some if found is None else found.unionByName(some)
    l = left.select(F.col(id).alias("a"), *[F.col(c).alias(f"l_{c}") for c in names])
    r = right.select(F.col(id).alias("b"), *[F.col(c).alias(f"r_{c}") for c in names])
    return found.distinct().join(l, "a").join(r, "b").select("a", "b", *[hamming(F.col(f"l_{c}"), F.col(f"r_{c}")).cast("long").alias(f"{c}_distance") for c in names])


def nearest(df: DataFrame, k: int, *, id: str = "id", code: str = "code", block: int = 2048, span: int = 1 << 20) -> DataFrame:
    """The k nearest other codes of each, ties by id: every block of codes against all codes, in spans.

    The method compares all pairs; a task holds one block's distances to one slice of codes, and k rows of each code and
    span leave it. Blocks and spans are dealt by hash, so neither grows with the input but their number.
    """
    n = df.count()
    blocks, spans = max(1, -(-n // block)), max(1, -(-n // span))
    # Codes travel packed: a row holds a piece of up to about `block` codes.
    piece = df.groupBy(F.pmod(F.xxhash64(id), F.lit(blocks)).alias("piece")).agg(F.array_sort(F.collect_list(F.struct(F.col(id).cast("long").alias("i"), F.col(code).cast("long").alias("c")))).alias("rows"))
    own = piece.select(F.col("piece").alias("block"), "rows", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spans - 1).cast("long"))).alias("span"), F.lit(True).alias("own"))
    every = piece.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "rows", F.pmod(F.col("piece"), F.lit(spans)).alias("span"), F.lit(False).alias("own"))
    both = own.unionByName(every)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        split = lambda rows: (np.array([x["i"] for x in rows], np.int64), np.array([x["c"] for x in rows], np.int64))
        mine = pdf.loc[pdf.own, "rows"]
        ids, codes = split(mine.iloc[0])
        best_d, best_i = np.full((len(ids), k), 1 << 20), np.full((len(ids), k), np.iinfo(np.int64).max)
        for rows in pdf.loc[~pdf.own, "rows"]:
            other, c = split(rows)
            d = np.bitwise_count((codes[:, None] ^ c[None, :]).view(np.uint64)).astype(np.int64)
            d[ids[:, None] == other[None, :]] = 1 << 20
            all_d, all_i = np.hstack([best_d, d]), np.hstack([best_i, np.broadcast_to(other, d.shape)])
            order = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best_d, best_i = np.take_along_axis(all_d, order, 1), np.take_along_axis(all_i, order, 1)
        keep = best_d < 1 << 20
        return pd.DataFrame({"i": np.repeat(ids, k)[keep.ravel()], "j": best_i[keep], "d": best_d[keep]})

    some = both.groupBy("block", "span").applyInPandas(run, "i long, j long, d long")
    best = some.groupBy("i").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "j"))), 1, k).alias("best"))  # k rows a span
    return best.select("i", F.posexplode("best").alias("rank", "n")).select("i", F.col("n.j").alias("j"), F.col("n.d").alias("distance"), (F.col("rank") + 1).cast("long").alias("rank"))


def mutual_edges(knn: DataFrame, threshold: int) -> DataFrame:
    """Pairs that are among each other's nearest and within the threshold."""
    near = knn.where(F.col("distance") <= threshold)
    return near.alias("x").join(near.select(F.col("i").alias("j"), F.col("j").alias("i")), ["i", "j"]).where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))


def shared_checkpoints(spark: SparkSession) -> None:
    """The context's checkpoint folder is the one that the session names."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def connected_components(nodes: DataFrame, edges: DataFrame, *, id: str = "id") -> DataFrame:
    """(id, label): the least id of each component; nodes without edges are their own.

    Every node and its neighbours are linked to the least of them until nothing changes; each round is checkpointed.
    """
    shared_checkpoints(nodes.sparkSession)
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = mark(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        now = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct().checkpoint()
        after = mark(now)
        if after == before:
            break
        before = after
    return nodes.select(F.col(id)).join(now.select(F.col("a").alias(id), F.col("b").alias("label")), id, "left").select(id, F.coalesce("label", id).alias("label"))


def sensitivity(nodes: DataFrame, pairs: DataFrame, thresholds: list[int], *, id: str = "id") -> DataFrame:
    """Clusters, the largest one and its percentage at each threshold; pairs are computed once at the largest."""
    out = None
    for t in thresholds:
        sizes = connected_components(nodes, pairs.where(F.col("distance") <= t).select("a", "b"), id=id).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        row = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), (100.0 * F.max("n") / F.sum("n")).alias("largest_pct")).withColumn("threshold", F.lit(t).cast("long"))
        out = row if out is None else out.unionByName(row)
    return out


def inspect_groups(df: DataFrame, group: str, *, class_: str = "class_label", centre: str = "centre") -> DataFrame:
    """Groups that mix classes or centres."""
    g = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(class_).alias("classes"), F.countDistinct(centre).alias("centres"))
    return g.where("classes > 1 or centres > 1")


def group_folds(df: DataFrame, repeats: int, folds: int, *, group: str = "group_id", label: str = "label_int") -> DataFrame:
    """(group, repeat, fold): stratified grouped folds.

    Groups come in a seeded hash order; each goes to the fold that keeps the classes' shares most even, ties to the
    fold with fewer rows. The greedy step is sequential, so a repeat is one task over one row a group (not a row of df).
    """
    counts = df.groupBy(group).agg(count_if(F.col(label) == 1).alias("pos"), count_if(F.col(label) == 0).alias("neg"))
    work = counts.withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long")))).withColumn("order", draw("fold", F.col("repeat"), F.col(group)))

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", group])
        y = pdf[["pos", "neg"]].to_numpy(float)
        total = np.maximum(y.sum(0), 1)
        filled, out = np.zeros((folds, 2)), np.zeros(len(pdf), np.int64)
        for i, g in enumerate(y):
            share = filled / total
            # The spread of each class's shares if the group went to fold f.
            s1, s2 = share.sum(0), (share**2).sum(0)
            new = share + g / total
            mean = (s1 + g / total) / folds
            var = np.maximum((s2 - share**2 + new**2) / folds - mean**2, 0)
            cost = np.sqrt(var).mean(1)
            best = np.flatnonzero(np.isclose(cost, cost.min()))
            f = best[np.argmin(filled[best].sum(1))]
            filled[f] += g
            out[i] = f
        return pd.DataFrame({group: pdf[group], "repeat": pdf["repeat"], "fold": out})

    return work.groupBy("repeat").applyInPandas(assign, f"{group} long, repeat long, fold long")


def verify_folds(df: DataFrame, fold: str, *, group: str = "group_id", label: str = "label_int") -> DataFrame:
    """One row a check with its value and whether it holds: no leaks, positives within 2, totals within 5 percent."""
    kept = df.where(F.col(fold) != -1)
    leaks = kept.groupBy(group).agg(F.countDistinct(fold).alias("k")).agg(count_if(F.col("k") > 1).alias("leaks"))
    per = kept.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"))
    even = per.agg((F.max("p") - F.min("p")).cast("double").alias("pos_range"), ((F.max("n") - F.min("n")) / F.avg("n")).alias("total_range"))
    wide = leaks.crossJoin(even)  # one row each
    rows = [("leaks", F.col("leaks").cast("double"), F.col("leaks") == 0), ("positives", F.col("pos_range"), F.col("pos_range") <= 2), ("totals", F.col("total_range"), F.col("total_range") <= 0.05)]
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("value"), ok.alias("holds")) for n, v, ok in rows])).alias("r")).select("r.*")


# ---- constraints: each returns the violations as counts, and `require` turns them into errors


def unique_key(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("times__")).agg(count_if(F.col("times__") > 1).alias("violations"))


def single_value(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.countDistinct(column) - 1).alias("violations"))


def null_pattern(df: DataFrame, required: list[str], conditional: dict[str, Column]) -> DataFrame:
    """Nulls in required columns, and columns that are null where they should not be or the other way round."""
    return df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in required], *[count_if(F.col(c).isNull() != cond).alias(c) for c, cond in conditional.items()])


def require(df: DataFrame, checks: DataFrame, message: str) -> DataFrame:
    """df, which fails when it is computed if checks.violations isn't 0."""
    bad = checks.select((F.col("violations") > 0).alias("bad__"))
    ok = F.when(F.col("bad__"), F.raise_error(F.lit(message)).cast("boolean")).otherwise(True)
    return df.crossJoin(F.broadcast(bad)).where(ok).drop("bad__")  # one row


def validate_dump(df: DataFrame, by: list[str], expected_rows: int) -> DataFrame:
    """(ok, reason) of each unit; the first check that fails gives the reason."""
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("filepath").alias("ids"), F.sum("label_int").alias("p"), count_if(F.isnan("logit") | F.col("logit").isNull() | (F.abs("logit") == float("inf"))).alias("bad"), F.countDistinct("logit").alias("values")
    )
    reason = F.when(F.col("n") < expected_rows, "rows").when(F.col("ids") < F.col("n"), "duplicates").when(F.col("p") == 0, "class balance").when(F.col("bad") > 0, "not finite").when(F.col("values") < 2, "degenerate").otherwise("ok")
    return g.select(*by, (reason == "ok").alias("ok"), reason.alias("reason"))


def validate_units(df: DataFrame, expected: DataFrame, by: list[str], held: dict[str, str]) -> DataFrame:
    """by, ok, reason of every expected unit (n_rows, n_pos): absent, row count, duplicates, class counts, a column that
    differs from the unit's own (held: column -> key), not finite, degenerate; the first fault gives the reason.

    An unreadable file or another schema fails before this, when the dump is read.
    """
    bad = F.isnan("logit") | F.col("logit").isNull() | (F.abs("logit") == float("inf"))
    g = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("filepath").alias("ids"), F.sum("label_int").alias("p"), count_if(bad).alias("bad"), F.countDistinct("logit").alias("values"), *[count_if(~F.col(c).eqNullSafe(F.col(k))).alias(f"off_{c}") for c, k in held.items()]
    )
    j = expected.join(g, by, "left")
    reason = F.when(F.col("n").isNull(), "absent").when(F.col("n") != F.col("n_rows"), "row count").when(F.col("ids") < F.col("n"), "duplicates").when(F.col("p") != F.col("n_pos"), "class counts")
    for c, k in held.items():
        reason = reason.when(F.col(f"off_{c}") > 0, f"{k} mismatch")
    reason = reason.when(F.col("bad") > 0, "not finite").when(F.col("values") <= 1, "degenerate").otherwise("ok")
    return j.select(*by, (reason == "ok").alias("ok"), reason.alias("reason"))


def distinct_scores(df: DataFrame, score: str, content: str, ratio: float = 0.99) -> DataFrame:
    """Whether nearly every distinct input got a score of its own."""
    return df.agg(F.countDistinct(score).alias("scores"), F.countDistinct(F.sha2(F.col(content).cast("string"), 256)).alias("inputs")).withColumn("ok", F.col("scores") > F.col("inputs") * ratio)
