"""Ranks, running sums and interpolation over ordered groups.

Ranks over a whole table are computed from tie groups, and prefix sums in two levels (range buckets, then rows within a
bucket), so that a group with most of the rows is still spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FINE = 128  # cells between a power of two and the next


def cell(value: Column, fine: int = FINE) -> Column:
    """A number that never falls as the value rises: sign, power of two and `fine` steps within it.

    It follows from the value alone, so that every use of it agrees, and outliers don't widen it. Null stays null, NaN
    is the largest. Only values within about a hundredth of each other share a cell.
    """
    size = F.abs(value.cast("double"))
    power = F.floor(F.log2(size))
    step = (power + 1100) * fine + F.floor((size / F.pow(F.lit(2.0), power) - 1) * fine) + 1
    top = 4000 * fine
    inside = F.when(size == 0, 0).when(size == float("inf"), top - 1).otherwise(step) * F.signum(value.cast("double"))
    return F.when(F.isnan(value.cast("double")), top).otherwise(F.when(size == 0, 0).otherwise(inside)).cast("long")


def attach(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of `other`, by keys that may be null."""
    if not keys:
        return df.crossJoin(F.broadcast(other))  # one row
    right = other.withColumnsRenamed({k: f"{k}_r__" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(right[f"{k}_r__"])
    return df.join(right, on).drop(*[f"{k}_r__" for k in keys])


def _before(placed: DataFrame, by: list[str], sums: dict[str, Column], descending: bool) -> DataFrame:
    """placed with each cell's sums over the cells before it."""
    totals = placed.groupBy(*by, "cell__").agg(*[c.alias(n) for n, c in sums.items()])
    key = F.desc("cell__") if descending else F.asc("cell__")
    window = W.partitionBy(*by).orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return attach(placed, totals.select(*by, "cell__", *[F.coalesce(F.sum(n).over(window), F.lit(0)).alias(n) for n in sums]), [*by, "cell__"])


def running_sums(df: DataFrame, by: list[str], order: str, sums: list[str], *, descending: bool = True, fine: int = FINE) -> DataFrame:
    """df with `<sum>_to`, the sum over all rows of the group that come before or with the row's value of `order`.

    Rows of equal `order` share one sum. Many small groups are better off with few cells (fine). A window runs over the totals of cells of neighbouring values, and one over
    the rows of each cell.
    """
    inner = F.desc(order) if descending else F.asc(order)
    within = W.partitionBy(*by, "cell__").orderBy(inner).rangeBetween(W.unboundedPreceding, W.currentRow)
    out = _before(df.withColumn("cell__", cell(F.col(order), fine)), by, {f"{s}__": F.sum(s) for s in sums}, descending)
    return out.select(*df.columns, *[(F.sum(s).over(within) + F.col(f"{s}__")).alias(f"{s}_to") for s in sums])


def with_ranks(df: DataFrame, by: list[str], value: str, *, descending: bool = False) -> DataFrame:
    """df with n__ (rows of the group), first__ (competition rank) and mean__ (average rank) of value."""
    ties = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties__"))
    ranked = running_sums(ties, by, value, ["ties__"], descending=descending)
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n__"))
    ranked = ranked.join(size, by) if by else ranked.crossJoin(F.broadcast(size))  # one row
    ranked = ranked.withColumn("first__", F.col("ties___to") - F.col("ties__") + 1).withColumn("mean__", F.col("first__") + (F.col("ties__") - 1) / F.lit(2.0))
    return df.join(ranked.select(*by, value, "n__", "first__", "mean__"), [*by, value])


def competition_rank(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    return with_ranks(df, by, value, descending=True).withColumn(name, F.col("first__").cast("long")).drop("n__", "first__", "mean__")


def average_rank(df: DataFrame, by: list[str], value: str, name: str = "avg_rank") -> DataFrame:
    return with_ranks(df, by, value).withColumn(name, F.col("mean__")).drop("n__", "first__", "mean__")


def percent_rank(df: DataFrame, by: list[str], value: str, name: str = "pct_rank", *, descending: bool = False) -> DataFrame:
    """Average rank over the number of rows (not Spark's percent_rank)."""
    return with_ranks(df, by, value, descending=descending).withColumn(name, F.col("mean__") / F.col("n__")).drop("n__", "first__", "mean__")


def mid_rank(df: DataFrame, by: list[str], value: str, name: str = "rank_norm") -> DataFrame:
    """(Average rank - 0.5) / number of rows, ascending."""
    return with_ranks(df, by, value).withColumn(name, (F.col("mean__") - 0.5) / F.col("n__")).drop("n__", "first__", "mean__")


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numbered(df: DataFrame, by: list[str], *order: Column | str, name: str = "rn") -> DataFrame:
    """Row numbers within groups, in a total order; "-x" is x falling.

    Where the first column of the order is a number, rows are numbered in two levels (cells, then rows in a cell), so
    that a few groups don't end in a few tasks.
    """
    columns = [(F.desc(o[1:]) if o.startswith("-") else F.asc(o)) if isinstance(o, str) else o for o in order]
    lead = order[0].lstrip("-") if isinstance(order[0], str) else None
    if lead is None or dict(df.dtypes).get(lead) not in NUMBERS:
        return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*columns)))
    out = _before(df.withColumn("cell__", cell(F.col(lead))), by, {"before__": F.count(F.lit(1))}, order[0].startswith("-"))
    place = F.row_number().over(W.partitionBy(*by, "cell__").orderBy(*columns)) + F.col("before__")
    return out.withColumn(name, place.cast("int")).select(*df.columns, name)


def placed(df: DataFrame, value: str, then: str, id: str, name: str = "place") -> DataFrame:
    """Row numbers over the whole table by value, then `then` falling, then the numeric id, from prefix sums: not in one partition."""
    count = F.count(F.lit(1)).alias("c__")
    above = running_sums(df.groupBy(value).agg(count), [], value, ["c__"], descending=False).select(value, (F.col("c___to") - F.col("c__")).alias("above__"))
    beside = running_sums(df.groupBy(value, then).agg(count), [value], then, ["c__"]).select(value, then, (F.col("c___to") - F.col("c__")).alias("beside__"))
    own = running_sums(df.withColumn("c__", F.lit(1)), [value, then], id, ["c__"], descending=False)
    return own.join(above, value).join(beside, [value, then]).withColumn(name, (F.col("above__") + F.col("beside__") + F.col("c___to")).cast("long")).drop("c__", "c___to", "above__", "beside__")


def top_k(df: DataFrame, by: list[str], k: int, *order: Column | str) -> DataFrame:
    return numbered(df, by, *order, name="rn__").where(F.col("rn__") <= k).drop("rn__")


def with_group(df: DataFrame, by: list[str], **aggregates: Column) -> DataFrame:
    """df with aggregates of each row's group attached (partial aggregation and a join, not a window)."""
    return df.join(df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()]), by)


def zscore(df: DataFrame, by: list[str], value: str, name: str = "z") -> DataFrame:
    """(x - mean) / sample standard deviation within the group."""
    return with_group(df, by, m__=F.avg(value), s__=F.stddev_samp(value)).withColumn(name, F.try_divide(F.col(value) - F.col("m__"), F.col("s__"))).drop("m__", "s__")


def centred(df: DataFrame, by: list[str], value: str, name: str = "centred") -> DataFrame:
    """x minus the group's median."""
    return with_group(df, by, m__=F.percentile(value, F.lit(0.5))).withColumn(name, F.col(value) - F.col("m__")).drop("m__")


def trailing_rate(df: DataFrame, by: list[str], order: str, amount: str, seconds: str, width: int) -> Column:
    w = W.partitionBy(*by).orderBy(order).rowsBetween(-(width - 1), W.currentRow)
    return F.try_divide(F.sum(amount).over(w), F.sum(seconds).over(w))


def crossing(df: DataFrame, by: list[str], x: str, y: str, target: float) -> DataFrame:
    """The first x at which y, linear between neighbouring x, meets the target (exact hits first)."""
    w = W.partitionBy(*by).orderBy(x)
    pairs = df.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    hit = pairs.where(F.col("y0") == target).groupBy(*by).agg(F.min("x0").alias("hit"))
    over = pairs.where((F.col("y0") - target) * (F.col("y1") - target) < 0)
    cut = over.groupBy(*by).agg(F.min_by(F.col("x0") + (target - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")), "x0").alias("cut"))
    return hit.join(cut, by, "full_outer").select(*by, F.coalesce("hit", "cut").alias("x"))


def interpolate(df: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """y at a point, linear between neighbours and constant beyond the ends."""
    w = W.partitionBy(*by).orderBy(x)
    pairs = df.select(*by, F.col(x).alias("x0"), F.col(y).alias("y0"), F.lead(x).over(w).alias("x1"), F.lead(y).over(w).alias("y1"))
    inside = (F.col("x0") <= at) & (F.col("x1") > at)
    line = F.col("y0") + (at - F.col("x0")) * (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0"))
    return pairs.groupBy(*by).agg(F.max(F.when(inside, line)).alias("m"), F.min("x0").alias("lo"), F.min_by("y0", "x0").alias("ylo"), F.max_by("y0", "x0").alias("yhi")).select(
        *by, F.coalesce("m", F.when(F.col("lo") > at, F.col("ylo")).otherwise(F.col("yhi"))).alias("y")
    )
