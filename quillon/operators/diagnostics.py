"""Rank correlations, tests, enrichment and thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import count_if, finite
from .windows import attach, average_rank, numbered


def dice_iou(a: Column, b: Column) -> tuple[Column, Column]:
    """Of two arrays as sets; two empty sets agree fully."""
    both, x, y = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return (
        F.when(x + y == 0, 1.0).otherwise(F.try_divide(2.0 * both, (x + y).cast("double"))),
        F.when(x + y == 0, 1.0).otherwise(F.try_divide(both.cast("double"), (x + y - both).cast("double"))),
    )


def positive_ranks(df: DataFrame, by: list[str], *, label: str = "label_int", score: str = "logit", id: str = "filepath", bottom: int = 16) -> DataFrame:
    """Positives numbered from the lowest score, with the number as a percentage and whether it is in the bottom."""
    pos = numbered(df.where(F.col(label) == 1), by, score, id, name="rank")
    n = pos.groupBy(*by).agg(F.count(F.lit(1)).alias("n__"))
    return pos.join(n, by).withColumn("percentile", F.col("rank") / F.col("n__") * 100.0).withColumn("in_bottom16", F.col("rank") <= bottom)


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """rho over finite pairs, with their number; null for under three pairs or a constant x."""
    rows = df.where(finite(F.col(x).cast("double")) & finite(F.col(y).cast("double")))
    ranked = average_rank(average_rank(rows, by, x, "rx__"), by, y, "ry__")
    n, distinct = F.count(F.lit(1)), F.countDistinct(x)
    return ranked.groupBy(*by).agg(n.alias("n"), F.when((n >= 3) & (distinct >= 2), F.corr("rx__", "ry__")).alias("rho"))


def mann_whitney(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """U of the rows whose group is 1, and U over the number of pairs."""
    ranked = average_rank(df, by, value, "r__")
    n1, n2 = count_if(F.col(group) == 1), count_if(F.col(group) == 0)
    u = F.sum(F.when(F.col(group) == 1, F.col("r__"))) - n1 * (n1 + 1) / 2.0
    return ranked.groupBy(*by).agg(n1.alias("n1"), n2.alias("n2"), u.alias("u"), F.try_divide(u, (n1 * n2).cast("double")).alias("auc"))


def mann_whitney_z(df: DataFrame, by: list[str], value: str, group: str) -> DataFrame:
    """mann_whitney with z, by the normal approximation with corrections for ties and continuity."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).cast("double").alias("t__"))
    ties = ties.groupBy(*by).agg(F.sum("t__").alias("rows__"), F.sum(F.pow("t__", F.lit(3.0)) - F.col("t__")).alias("ties__"))
    j = attach(mann_whitney(df, by, value, group), ties, by)
    gap = F.col("u") - F.col("n1") * F.col("n2") / 2.0
    n = F.col("rows__")
    var = F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.coalesce(F.try_divide(F.col("ties__"), n * (n - 1)), F.lit(0.0)))
    return j.withColumn("z", F.try_divide(gap - 0.5 * F.signum(gap), F.sqrt(var))).drop("rows__", "ties__")


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of all combinations of the values of a and b, zeros included."""
    n = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct())  # of distinct values
    return grid.join(n, [a, b], "left").select(a, b, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Statistic and degrees of freedom of independence; 2 x 2 tables get Yates' correction."""
    t = contingency(df, a, b)
    rows, cols, total = t.groupBy(a).agg(F.sum("n").alias("r")), t.groupBy(b).agg(F.sum("n").alias("c")), t.agg(F.sum("n").alias("t"), F.countDistinct(a).alias("ka"), F.countDistinct(b).alias("kb"))
    e = t.join(rows, a).join(cols, b).crossJoin(F.broadcast(total)).withColumn("e", F.col("r") * F.col("c") / F.col("t"))  # one row
    gap = F.abs(F.col("n") - F.col("e"))
    yates = F.when((F.col("ka") == 2) & (F.col("kb") == 2), gap - F.least(gap, F.lit(0.5))).otherwise(gap)
    return e.agg(F.sum(yates * yates / F.col("e")).alias("chi2"), F.max((F.col("ka") - 1) * (F.col("kb") - 1)).cast("long").alias("dof"))


def log_factorial(n: int) -> float:
    return math.lgamma(n + 1)


def hypergeometric_tail(k: Column, drawn: Column, good: Column, total: Column) -> Column:
    """P(X >= k): `drawn` of `total`, `good` of which count; sums of log factorials over an array, no UDF.

    A term's logarithm is built from the one before it, so the work is one step a term.
    """
    log_choose = lambda n, r: F.aggregate(F.sequence(F.lit(1), F.greatest(r, F.lit(1))), F.lit(0.0), lambda s, i: s + F.when(i <= r, F.log((n - r + i).cast("double")) - F.log(i.cast("double"))).otherwise(0.0))
    top = F.least(drawn, good)
    term = lambda x: F.exp(log_choose(good, x) + log_choose(total - good, drawn - x) - log_choose(total, drawn))
    feasible = lambda x: (x >= F.greatest(F.lit(0), drawn - (total - good))) & (x <= top)
    return F.aggregate(F.sequence(F.least(k, top), top), F.lit(0.0), lambda s, x: s + F.when(feasible(x) & (x >= k), term(x)).otherwise(0.0))


def enrichment(df: DataFrame, by: list[str], category: str, score: str, id: str, n: int) -> DataFrame:
    """Each category's share of the n highest scores over its share of all rows; null where it has none."""
    top = numbered(df, by, f"-{score}", id, name="rn__")
    counted = top.groupBy(*by, category).agg(F.count(F.lit(1)).alias("all_n"), count_if(F.col("rn__") <= n).alias("top_n"))
    totals = counted.groupBy(*by).agg(F.sum("all_n").alias("a__"), F.sum("top_n").alias("t__"))
    joined = counted.join(totals, by) if by else counted.crossJoin(F.broadcast(totals))  # one row
    return joined.select(*by, category, "all_n", "top_n", F.try_divide(F.col("top_n") / F.col("t__"), F.col("all_n") / F.col("a__")).alias("ratio"))


def histogram(df: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """Counts of equal-width bins (the last one closed), empty ones included: by, bin, n, and the bin's centre."""
    span = df.groupBy(*by).agg(F.min(value).alias("lo__"), F.max(value).alias("hi__"))
    joined = df.join(span, by) if by else df.crossJoin(F.broadcast(span))  # one row
    place = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("lo__")) * bins, F.col("hi__") - F.col("lo__")), F.lit(0.0)))).cast("long")
    n = joined.withColumn("bin", place).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = span.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    centre = F.col("lo__") + (F.col("bin") + 0.5) * (F.col("hi__") - F.col("lo__")) / bins
    return grid.join(n, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), centre.alias("centre"))


def otsu(df: DataFrame, by: list[str], value: str, bins: int = 256) -> DataFrame:
    """The histogram centre that maximises the variance between the two sides, the first of equals."""
    h = histogram(df, by, value, bins)
    below = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*by)
    cut = h.select(*by, "bin", "centre", F.sum("n").over(below).alias("w0"), F.sum(F.col("n") * F.col("centre")).over(below).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("centre")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    between = F.when((F.col("w0") > 0) & (w1 > 0), F.col("w0") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, 2))
    return cut.withColumn("v", F.round(between, 3)).groupBy(*by).agg(F.max_by("centre", F.struct(F.coalesce("v", F.lit(-1.0)), -F.col("bin"))).alias("threshold"))


def bit_identity(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Compare two tables of values by key: matched rows, rows that differ, the largest gap, and a status."""
    j = a.select(*keys, F.col(value).alias("a")).withColumn("in_a", F.lit(True)).join(b.select(*keys, F.col(value).alias("b")).withColumn("in_b", F.lit(True)), keys, "full_outer")
    out = j.agg(count_if(F.col("in_a") & F.col("in_b")).alias("n"), count_if(F.col("in_a").isNull()).alias("extra"), count_if(F.col("in_b").isNull()).alias("missing"), count_if(F.col("a") != F.col("b")).alias("n_differ"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_gap"))
    status = F.when(F.col("extra") + F.col("missing") > 0, "keys differ").when(F.col("n_differ") == 0, "identical").when(F.col("max_gap") < 1e-6, "close").otherwise("different")
    return out.withColumn("status", status)


def kendall_tau(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """tau-b from tie counts and a grid of joint value counts: exact, and quadratic in distinct (x, y) pairs of a group,
    so for grouped or rounded scores; concordance is counted between distinct pairs, not rows."""
    c = df.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("n"))
    l, r = c.alias("l"), c.select(*by, F.col(x).alias("x2"), F.col(y).alias("y2"), F.col("n").alias("n2")).alias("r")
    sign = F.signum((F.col(x) - F.col("x2")) * (F.col(y) - F.col("y2")))
    s = l.join(r, by).where(F.col(x) < F.col("x2")).groupBy(*by).agg(F.sum(sign * F.col("n") * F.col("n2")).alias("s"))
    total = c.groupBy(*by).agg(F.sum("n").alias("t"))
    tied = lambda v, name: c.groupBy(*by, v).agg(F.sum("n").alias("k")).groupBy(*by).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias(name))
    j = s.join(total, by).join(tied(x, "tx"), by).join(tied(y, "ty"), by)
    pairs = F.col("t") * (F.col("t") - 1) / 2
    return j.select(*by, F.try_divide(F.col("s"), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))).alias("tau"))
