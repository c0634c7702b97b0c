"""Bootstraps, weighted draws and simulations with a keyed-hash random source.

A draw depends only on its keys, so partitioning and retries don't change it, and other SQL engines can repeat it.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import TWO60, draw, uniform
from .ranking import RECALL, curve
from .strata import prior_weights, with_threshold
from .windows import numbered, running_sums


#: Tie groups that a task keeps as arrays (some 50 bytes each); a longer curve stays in Spark.
MOST_TIES = 1_000_000


def _simulated(plan: DataFrame, names: list[str], run) -> DataFrame:
    """plan with the double columns that `run` gives for each of its rows (a tuple of Python values)."""
    import pyarrow as pa

    schema = ", ".join([*(f"`{n}` {t}" for n, t in plan.dtypes), *(f"{n} double" for n in names)])

    def batches(parts):
        for part in parts:
            found = [run(*row) for row in zip(*(c.to_pylist() for c in part.columns), strict=True)]
            columns = [pa.array(c, pa.float64()) for c in (zip(*found, strict=True) if found else ([] for _ in names))]
            yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *names])

    return plan.mapInArrow(batches, schema)


def _draw_rows(df: DataFrame, draws: int) -> DataFrame:
    """(draw): several tasks for each core, a draw at least in each."""
    spark = df.sparkSession
    return spark.range(0, draws, 1, max(1, min(draws, 4 * spark.sparkContext.defaultParallelism))).select(F.col("id").alias("draw"))


def keyed_numbers(seed: int, draw: int, first: int, stop: int) -> np.ndarray:
    """draw(seed, draw, k) of functions.scalar for k from first to stop - 1."""
    head, new = f"{seed}|{draw}|".encode(), hashlib.sha256
    return (np.frombuffer(b"".join([new(b"%b%d" % (head, k)).digest() for k in range(first, stop)]), ">u8")[::4] >> np.uint64(4)).astype(np.int64)


def prevalence_bootstrap(
    df: DataFrame, *, draws: int, by: list[str] | None = None, ratio: int = 100, recall: float = 0.9, label: str = "label_int", score: str = "logit", seed: int = 0, most: int = MOST_TIES
) -> DataFrame:
    """(by, draw, roc_auc, ap, ppv): each draw keeps all negatives and max(1, N / ratio) positives with replacement.

    The negatives above and at each positive's score are counted once; a draw touches only its positives. Tie groups with
    positives, up to `most` of all groups, go to the tasks as arrays, and a draw is made in one task without a shuffle
    (groups share its hashes). More of them are joined with the picks in Spark; both ways give the same draws. A group
    without positives has no draws; without negatives its roc_auc is null.
    """
    by = by or []
    c = curve(df, by, label=label, score=score).where("pos > 0")
    c = c.select(*by, "pos", "P", "N", (F.col("fp") - F.col("neg")).alias("g__"), F.col("fp").alias("h__"), "tp")
    found = c.limit(most + 1).toArrow()
    if found.num_rows > most:
        return _joined_draws(c, by, draws=draws, ratio=ratio, recall=recall, seed=seed)
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(*(found[k].to_pylist() for k in by), strict=True) if by else [()] * found.num_rows):
        rows.setdefault(key, []).append(i)
    groups = []
    for members in rows.values():
        part = {n: found[n].to_numpy()[members].astype(np.int64) for n in ("tp", "g__", "h__", "P", "N")}
        order = np.argsort(part["tp"])
        tp, g, h = (part[n][order] for n in ("tp", "g__", "h__"))
        last = np.r_[(g[1:] != g[:-1]) | (h[1:] != h[:-1]), True]  # scores without a negative between count as one
        groups.append((max(1, int(part["N"][0]) // ratio), int(part["P"][0]), int(part["N"][0]), tp[last], g[last], h[last]))

    def measures(m: int, n: int, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        g, h, x = g[x > 0], h[x > 0], x[x > 0]
        k1 = np.cumsum(x)
        k0 = k1 - x
        auc = float((x * (1 - (g + h) / 2.0 / n)).sum() / m) if n else None
        at = np.flatnonzero((k0 / m <= recall) & (k1 / m > recall))
        ppv = None
        if len(at):
            a0, a1, ax, ag, ah = (int(v[at[0]]) for v in (k0, k1, x, g, h))
            start = a0 / (a0 + ag) if a0 + ag > 0 else 1.0
            ppv = start + (recall - a0 / m) / (ax / m) * (a1 / (a1 + ah) - start)
        return auc, float((x / m * (k1 / (k1 + h))).sum()), ppv

    def run(number: int) -> list[tuple]:
        counts, largest, step = [np.zeros(len(q[3]), np.int64) for q in groups], max(q[0] for q in groups), 1 << 18
        for first in range(1, largest + 1, step):
            drawn = keyed_numbers(seed, number, first, min(first + step, largest + 1))
            for (m, total, _, tp, _, _), x in zip(groups, counts, strict=True):
                if first <= m:
                    x += np.bincount(np.searchsorted(tp, drawn[: m - first + 1] % total, side="right"), minlength=len(tp))
        return [measures(m, n, x, g, h) for (m, _, n, _, g, h), x in zip(groups, counts, strict=True)]

    names = ["roc_auc", "ap", "ppv"]
    if not groups:
        return c.select(*by, F.lit(0).cast("long").alias("draw"), *[F.lit(None).cast("double").alias(n) for n in names]).where("false")
    wide = _simulated(_draw_rows(df, draws), [f"{n}_{i}" for i in range(len(groups)) for n in names], lambda number: [v for q in run(number) for v in q])
    field = lambda f, v: F.lit(v).cast(f.dataType).alias(f.name)
    each = [F.struct(*[field(f, v) for f, v in zip(c.select(*by).schema, key, strict=True)], *[F.col(f"{n}_{i}").alias(n) for n in names]) for i, key in enumerate(rows)]
    return wide.select("draw", F.explode(F.array(*each)).alias("r")).select(*[F.col(f"r.{k}").alias(k) for k in by], "draw", *[f"r.{n}" for n in names])


def _joined_draws(c: DataFrame, by: list[str], *, draws: int, ratio: int, recall: float, seed: int) -> DataFrame:
    """prevalence_bootstrap's draws by shuffled joins: Spark can't see how many rows explode gives, and would broadcast them."""
    from pyspark.sql import Window as W

    size = c.groupBy(*by).agg(F.greatest(F.lit(1), F.floor(F.max("N") / ratio)).cast("long").alias("m"), F.max("P").alias("total"))
    plan = _draw_rows(c, draws).crossJoin(F.broadcast(size)).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))  # a row of sizes for each group
    picks = plan.withColumn("index", draw(seed, F.col("draw"), F.col("k")) % F.col("total")).groupBy(*by, "draw", "m", "index").agg(F.count(F.lit(1)).alias("times"))
    # A picked index is the tie group whose range of ranks holds it; one row for every positive stands for its rank.
    ranked = c.withColumn("index", F.explode(F.sequence(F.col("tp") - F.col("pos"), F.col("tp") - 1)))
    s = picks.hint("merge").join(ranked.hint("merge"), [*by, "index"]).groupBy(*by, "draw", "m", "N", "g__", "h__").agg(F.sum("times").alias("x"), F.max("tp").alias("order"))
    k1 = F.sum("x").over(W.partitionBy(*by, "draw").orderBy("order").rowsBetween(W.unboundedPreceding, 0))
    s = s.withColumn("k1", k1).withColumn("k0", F.col("k1") - F.col("x"))
    here = (F.col("k0") / F.col("m") <= recall) & (F.col("k1") / F.col("m") > recall)
    start = F.when(F.col("k0") + F.col("g__") > 0, F.col("k0") / (F.col("k0") + F.col("g__"))).otherwise(1.0)
    ppv = start + (recall - F.col("k0") / F.col("m")) / (F.col("x") / F.col("m")) * (F.col("k1") / (F.col("k1") + F.col("h__")) - start)
    return s.groupBy(*by, "draw").agg(
        (F.sum(F.col("x") * (1 - F.try_divide((F.col("g__") + F.col("h__")) / 2.0, F.col("N")))) / F.max("m")).alias("roc_auc"),
        F.sum(F.col("x") / F.col("m") * F.col("k1") / (F.col("k1") + F.col("h__"))).alias("ap"),
        F.max(F.when(here, ppv)).alias("ppv"),
    )


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Median and 2.5 / 97.5 percentiles of each column, a row each."""
    long = df.unpivot([], columns, "metric", "v")
    q = F.percentile("v", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return long.groupBy("metric").agg(q.alias("q"), F.count("v").alias("n")).select("metric", "n", F.get("q", F.lit(0)).alias("lo"), F.get("q", F.lit(1)).alias("median"), F.get("q", F.lit(2)).alias("hi"))


def auc_bootstrap(df: DataFrame, *, draws: int, label: str = "label_int", score: str = "logit", seed: int = 0) -> DataFrame:
    """(draw, roc_auc): every row weighs a Poisson(1) count in each draw; draws of one class give null.

    The n rows of a score and label weigh Poisson(n) together, so tie groups are drawn, not rows; a group's generator is
    keyed by seed and score. Sorted partitions of groups keep three running numbers a draw, and the partitions' sums are
    put together in order; nothing grows with rows x draws but the time.
    """
    from pyspark import TaskContext
    from pyspark.sql import Window as W

    ties = df.groupBy(F.col(score).alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    order = F.asc_nulls_first("score")  # as in a curve, null is least and NaN largest
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    ties = ties.where("pos > 0 OR neg > 0").repartitionByRange(tasks, order).sortWithinPartitions(order)

    def run(parts):
        import pyarrow as pa

        pos, neg, pairs = (np.zeros(draws) for _ in range(3))
        for part in parts:
            for value, p, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
                key = hashlib.blake2b(repr(value).encode(), digest_size=16, salt=(seed & (1 << 64) - 1).to_bytes(8, "little")).digest()
                rng = np.random.Generator(np.random.Philox(key=np.frombuffer(key, np.uint64)))
                w0 = rng.poisson(n, draws) if n else 0
                if p:
                    w1 = rng.poisson(p, draws)
                    pairs += w1 * (neg + w0 / 2.0)
                    pos += w1
                neg += w0
        if pos.any() or neg.any():
            place = np.full(draws, TaskContext.get().partitionId())  # ranges are dealt in order
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place, np.arange(draws), pos, neg, pairs)], names=["place", "draw", "pos", "neg", "pairs"])

    sums = ties.mapInArrow(run, "place long, draw long, pos double, neg double, pairs double")
    before = F.coalesce(F.sum("neg").over(W.partitionBy("draw").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    placed = sums.withColumn("pairs", F.col("pairs") + F.col("pos") * before)
    return placed.groupBy("draw").agg(F.try_divide(F.sum("pairs"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def stratified_subsample(df: DataFrame, quotas: DataFrame, stratum: str, id: str, seed: int, *, by: list[str] | None = None) -> DataFrame:
    """Of each stratum the first `quota` rows in a keyed-hash order, without replacement."""
    keys = [*(by or []), stratum]
    order = draw(seed, *[F.col(k) for k in by or []], F.col(id))
    return numbered(df.withColumn("h__", order), keys, "h__", id, name="rn__").join(quotas, stratum).where(F.col("rn__") <= F.col("quota")).drop("h__", "rn__", "quota")


def proportional_quotas(df: DataFrame, stratum: str, total: int) -> DataFrame:
    """Shares of `total` by stratum, rounded down, the remainder to the strata first by name."""
    n = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    all_n = n.agg(F.sum("n").alias("t"))
    base = n.crossJoin(F.broadcast(all_n)).withColumn("quota", F.floor(F.lit(total) * F.col("n") / F.col("t")))  # one row
    left = base.agg((F.lit(total) - F.sum("quota")).alias("left"))
    return numbered(base.withColumn("one__", F.lit(1)), ["one__"], stratum, name="rn__").crossJoin(F.broadcast(left)).select(stratum, (F.col("quota") + (F.col("rn__") <= F.col("left")).cast("long")).cast("long").alias("quota"))


def prior_equalised_bootstrap(df: DataFrame, stratum: str, *, draws: int, recall: float = RECALL, label: str = "label_int", score: str = "logit", id: str = "filepath", seed: int = 0) -> DataFrame:
    """(draw, fpr, n): the rate of negatives at or above the threshold at the recall, over subsamples without replacement.

    A stratum gives round(weight * negatives) of its negatives (halves to even), the anchor all of them; weights are
    those of prior_weights, the threshold is that of the whole table. Of k rows drawn from a stratum without replacement
    the number at or above the threshold is hypergeometric in the stratum's counts, and is drawn as such: all negatives
    count, and the work for a draw doesn't grow with them. A stratum may have up to 10 ** 9 negatives (numpy's limit).
    """
    quotas = prior_weights(df, stratum, label=label).select(stratum, F.bround(F.col("weight") * F.col("n_neg")).cast("long").alias("quota"))
    rows = with_threshold(df, [], recall, label=label, score=score).where(F.col(label) == 0)
    counts = rows.groupBy(stratum).agg(F.count_if(F.col(score) >= F.col("threshold")).alias("above"), F.count(F.lit(1)).alias("all")).join(quotas, stratum)

    @F.udf("long", useArrow=False)
    def drawn(number: int, name: str, above: int, n: int, k: int) -> int:
        return int(np.random.default_rng([seed, number, zlib.crc32(name.encode())]).hypergeometric(above, n - above, k))

    each = counts.crossJoin(df.sparkSession.range(draws).select(F.col("id").alias("draw"))).withColumn("x", drawn("draw", F.col(stratum).cast("string"), "above", "all", "quota"))
    return each.groupBy("draw").agg((F.sum("x") / F.sum("quota")).alias("fpr"), F.sum("quota").alias("n"))


def weighted_draw(df: DataFrame, n: int, strata: list[str], id: str, seed: int) -> DataFrame:
    """(k, id, strata): n draws with replacement; every stratum has the same chance, every row within it too."""
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size")).withColumn("one__", F.lit(1))
    order = numbered(sizes, ["one__"], *strata, name="s__").drop("one__")
    count = order.agg(F.count(F.lit(1)).alias("c__"))
    picks = df.sparkSession.range(n).select(F.col("id").alias("k")).crossJoin(F.broadcast(count)).withColumn("s__", (draw(seed, "s", F.col("k")) % F.col("c__") + 1).cast("int"))  # one row
    picks = picks.join(order.withColumn("s__", F.col("s__").cast("int")), "s__").withColumn("r__", (draw(seed, "r", F.col("k")) % F.col("size") + 1).cast("int"))
    rows = numbered(df.select(*strata, id), strata, id, name="r__")
    return picks.select("k", *strata, "r__").join(rows, [*strata, "r__"]).select("k", id, *strata)


def score_ties(df: DataFrame, *, label: str = "label_int", score: str = "logit", most: int = MOST_TIES):
    """(scores rising, positives, negatives) of df's tie groups as arrays, or None if they are more than `most`.

    A null score is the least (as minus infinity), NaN the largest.
    """
    ties = df.groupBy(F.col(score).cast("double").alias("score")).agg(F.sum(label).cast("long").alias("pos"), F.sum(1 - F.col(label)).cast("long").alias("neg"))
    found = ties.where("pos > 0 OR neg > 0").limit(most + 1).toArrow()
    if found.num_rows > most:
        return None
    v = found["score"].to_numpy().copy()
    v[found["score"].is_null().to_numpy()] = -np.inf
    order = np.argsort(v, kind="stable")
    return v[order], found["pos"].to_numpy()[order], found["neg"].to_numpy()[order]


def _counts_auc(v: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float | None:
    """AUROC of scores that stand for pos and neg rows each; equal scores are ties, null without both classes."""
    if not pos.any() or not neg.any():
        return None
    order = np.argsort(v, kind="stable")
    v = v[order]
    starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) & ~(np.isnan(v[1:]) & np.isnan(v[:-1]))])
    p, n = (np.add.reduceat(x[order], starts).astype(float) for x in (pos, neg))
    return float((p * (np.cumsum(n) - n / 2)).sum() / (p.sum() * n.sum()))


def offset_simulation(
    df: DataFrame, grid: DataFrame, draws: int, *, label: str = "label_int", score: str = "logit", id: str = "filepath", seed: int = 0, most: int = MOST_TIES, ties: tuple | None = None
) -> DataFrame:
    """(k, sd, draw, roc_auc): every row gets one of k centres, every centre a normal offset of standard deviation sd.

    Of the n rows of a score and label the numbers in the centres are multinomial, and are drawn as such (keyed by seed,
    draw and k) for up to `most` tie groups, which go to the tasks as arrays; `ties` gives those of df, if at hand. More
    of them are simulated row by row in Spark, by other draws of the same distribution. Offsets are keyed hashes in both.
    """
    ties = score_ties(df, label=label, score=score, most=most) if ties is None else ties
    if ties is None:
        return _simulated_rows(df, grid, draws, label=label, score=score, id=id, seed=seed)
    v, pos, neg = ties

    def run(k: int, sd: float, number: int) -> tuple:
        def part(letter: str, centre: int) -> float:
            return (int(hashlib.sha256(f"{seed}|{letter}|{number}|{centre}".encode()).hexdigest()[:15], 16)) / TWO60

        offsets = [math.sqrt(-2 * math.log(max(part("u", c), 1e-18))) * math.cos(2 * math.pi * part("v", c)) for c in range(k)]
        rng = np.random.default_rng([seed, number, k])
        p, n = (rng.multinomial(x, np.full(k, 1 / k)).T.ravel() for x in (pos, neg))
        there = (p > 0) | (n > 0)
        return (_counts_auc(np.concatenate([v + sd * o for o in offsets])[there], p[there], n[there]),)

    return _simulated(_draw_rows(df, draws).crossJoin(F.broadcast(grid)).select("k", "sd", "draw"), ["roc_auc"], run)  # a stated grid


def _simulated_rows(df: DataFrame, grid: DataFrame, draws: int, *, label: str, score: str, id: str, seed: int) -> DataFrame:
    """offset_simulation with a row for each row, draw and grid point."""
    plan = grid.withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))))
    moved = df.crossJoin(F.broadcast(plan)).withColumn("centre__", draw(seed, "c", F.col("draw"), F.col(id)) % F.col("k"))  # a stated grid
    u, v = uniform(seed, "u", F.col("draw"), F.col("centre__")), uniform(seed, "v", F.col("draw"), F.col("centre__"))
    normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-18)))) * F.cos(2 * F.lit(3.141592653589793) * v)
    moved = moved.withColumn("s__", F.col(score) + F.col("sd") * normal)
    from .ranking import auc

    return curve(moved, ["k", "sd", "draw"], label=label, score="s__", fine=8).groupBy("k", "sd", "draw").agg(auc().alias("roc_auc"))


def shifted(df: DataFrame, shifts: list[float], *, label: str = "label_int", score: str = "logit") -> DataFrame:
    """df once for each shift, with the positives' scores moved by it."""
    return df.withColumn("shift", F.explode(F.array(*[F.lit(float(x)) for x in shifts]))).withColumn(score, F.col(score) + F.col("shift") * F.col(label))


def epoch_seed(seed: Column, epoch: Column) -> Column:
    """(seed * 1000003 + epoch * 9176053 + 17) mod (2^63 - 1), without overflow."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.pmod(wide(seed) * 1000003 + wide(epoch) * 9176053 + 17, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def spread_negatives(df: DataFrame, factors: list[float], *, label: str = "label_int", score: str = "logit") -> DataFrame:
    """df once for each factor m, with the negatives' distances from their mean multiplied by it."""
    mean = df.where(F.col(label) == 0).agg(F.avg(score).alias("mean__"))
    moved = F.when(F.col(label) == 0, F.col("mean__") + F.col("m") * (F.col(score) - F.col("mean__"))).otherwise(F.col(score))
    return df.crossJoin(F.broadcast(mean)).withColumn("m", F.explode(F.array(*[F.lit(float(x)) for x in factors]))).withColumn(score, moved).drop("mean__")  # one row


def empirical_draws(df: DataFrame, value: str, n: int, seed: int) -> DataFrame:
    """(item, value): n draws from the distribution of a column of few values, through its inverse."""
    from pyspark.sql import Window as W

    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("c").over(W.partitionBy())
    cdf = counts.select(value, (upto / whole).alias("hi"), ((upto - F.col("c")) / whole).alias("lo"))
    items = df.sparkSession.range(n).select(F.col("id").alias("item")).withColumn("u", uniform(seed, F.col("item")))
    return items.join(F.broadcast(cdf), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("item", value)  # a row a distinct value


def probe_selection(df: DataFrame, total: int, positives: int, *, seed: int, stratum: str = "centre", label: str = "label_int", id: str = "filepath") -> DataFrame:
    """`total` rows of df: a floor of positives split by the strata's shares of them, the rest negatives by theirs.

    A stratum gets its rounded share (half to even, one at least), the last by name what is left; rows are taken in a
    keyed-hash order. What a stratum lacks is filled from all other rows in that order, a surplus is cut in it.
    """
    from pyspark.sql import Window as W

    counts = df.groupBy(stratum, label).agg(F.count(F.lit(1)).alias("n"))

    def quotas(of: DataFrame, want) -> DataFrame:
        whole = W.partitionBy()
        share = F.greatest(F.bround(want * F.col("n") / F.sum("n").over(whole)), F.lit(1.0))
        last = F.col(stratum) == F.max(stratum).over(whole)
        rows = of.withColumn("last__", last).withColumn("q__", F.when(last, 0.0).otherwise(share))
        return rows.select(stratum, label, "n", F.when(F.col("last__"), want - F.sum("q__").over(whole)).otherwise(F.col("q__")).alias("quota"))

    pos = quotas(counts.where(F.col(label) == 1), F.lit(float(positives)))
    got = pos.agg(F.coalesce(F.sum(F.least("quota", "n")), F.lit(0.0)).alias("got__"))
    neg = quotas(counts.where(F.col(label) == 0).crossJoin(F.broadcast(got)), total - F.col("got__"))  # one row
    plan = pos.unionByName(neg).select(stratum, label, "quota")
    keyed = df.withColumn("h__", draw(seed, F.col(id)))
    rows = numbered(keyed, [stratum, label], "h__", id, name="rn__").join(F.broadcast(plan), [stratum, label], "left")  # a row a stratum and label
    rows = rows.withColumn("later__", (F.col("rn__") > F.coalesce("quota", F.lit(0.0))).cast("int"))
    return rows.orderBy("later__", "h__", id).limit(total).select(*df.columns)


def sd_for_target(df: DataFrame, k: int, target: float, *, draws: int, start: float = 1.0, most: int = 20, width: float = 0.005, seed: int = 0) -> tuple:
    """(sd, highest sd tried, median there, steps): where the median AUROC under random centre offsets falls to a target.

    The upper end is doubled until the median is at or below the target (none found: a null sd), then the bracket is
    halved to `width`. One simulation a step; the driver holds one number of each.
    """
    spark, steps, ties = df.sparkSession, 0, score_ties(df)

    def median(sd: float) -> float:
        nonlocal steps
        steps += 1
        sims = offset_simulation(df, spark.createDataFrame([(k, sd)], "k long, sd double"), draws, seed=seed, ties=ties)
        return sims.agg(F.percentile("roc_auc", F.lit(0.5))).first()[0]

    low, high = 0.0, start
    at = median(high)
    for _ in range(most):
        if at <= target:
            break
        low, high = high, high * 2
        at = median(high)
    top, at_top = high, at
    if at > target:
        return None, top, at_top, steps
    while high - low >= width:
        middle = (low + high) / 2
        low, high = (middle, high) if median(middle) > target else (low, middle)
    return (low + high) / 2, top, at_top, steps
