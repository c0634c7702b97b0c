"""Splits, checked joins, frequency tables and set comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import count_if, draw, r6
from .windows import numbered, running_sums


def cv_split(m: DataFrame, repeat: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, validation) of one repeat and fold; rows with the sentinel -1 are in neither."""
    c = F.col(f"fold_r{repeat}")
    return m.where((c != fold) & (c != -1)), m.where(c == fold)


def holdout_split(m: DataFrame, centre: str) -> tuple[DataFrame, DataFrame]:
    """(train, test): the sentinel is filtered from the train side only."""
    return m.where((F.col("centre") != centre) & (F.col("fold_r0") != -1)), m.where(F.col("centre") == centre)


def permuted(df: DataFrame, seed: int, id: str) -> DataFrame:
    """Positions in an order by a keyed hash, numbered by prefix sums over ranges of the hash.

    The order is never the ids' own: where the hash happens to sort two ids or more, all positions move on by one.
    """
    h = df.withColumn("h__", draw(seed, F.col(id)))
    at = running_sums(h.groupBy("h__").agg(F.count(F.lit(1)).alias("k__")), [], "h__", ["k__"], descending=False)
    ties = numbered(h, ["h__"], id, name="t__")
    placed = ties.join(at, "h__").withColumn("position", (F.col("k___to") - F.col("k__") + F.col("t__")).cast("long")).drop("h__", "k__", "k___to", "t__")
    follows = placed.select(F.col(id).alias("next__"), (F.col("position") - 1).alias("position"))
    falls = placed.select(F.col(id).alias("own__"), "position").join(follows, "position").agg(F.coalesce(F.bool_or(F.col("own__") > F.col("next__")), F.lit(False)).alias("falls__"), F.count(F.lit(1)).alias("n__"))
    moved = F.when(F.col("falls__") | (F.col("n__") == 0), F.col("position")).otherwise(F.col("position") % (F.col("n__") + 1) + 1)
    return placed.crossJoin(F.broadcast(falls)).withColumn("position", moved).drop("falls__", "n__")  # one row


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def score_as_logit(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("logit", F.col(score))


def consolidate(base: DataFrame, features: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins one after another; Spark broadcasts those whose measured size allows it."""
    return reduce(lambda df, f: df.join(f[0], f[1], "left"), features, base)


def suffix_join(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join that keeps both copies of columns that both sides have."""
    renamed = right.select(key, *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != key])
    return left.join(renamed, key, "left")


def aligned_join(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """One-to-one join that fails unless both sides have the same keys and agree on the label; other columns get _a, _b."""
    side = lambda df, s: df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in df.columns if c not in keys], F.lit(True).alias(f"in_{s}__"))
    j = side(a, "a").join(side(b, "b"), keys, "full_outer")
    good = F.col("in_a__").isNotNull() & F.col("in_b__").isNotNull() & F.col(f"{label}_a").eqNullSafe(F.col(f"{label}_b"))
    checked = j.withColumn("ok__", F.when(good, True).otherwise(F.raise_error(F.lit("the two sides differ in keys or labels")).cast("boolean")))
    return checked.where("ok__").drop("ok__", "in_a__", "in_b__")


def without_leaks(val: DataFrame, train: DataFrame, keys: list[str]) -> DataFrame:
    return val.join(train.select(*keys).distinct(), keys, "left_anti")


def unit_grid(spark: SparkSession, *, repeats: int, seeds: int, folds: int) -> DataFrame:
    """Every (seed, repeat, fold) and its name."""
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    grid = spark.range(seeds).select(F.col("id").alias("seed")).withColumn("repeat", axis(repeats)).withColumn("fold", axis(folds))
    return grid.withColumn("name", F.format_string("r%d_f%d_s%d", "repeat", "fold", "seed"))


def resolve_aliases(arms: DataFrame, limit: int = 20) -> DataFrame:
    """key -> the arm at the end of its same_as chain; the table of arms is small. A cycle is an error."""
    at = arms.select("key", F.col("key").alias("resolved"))
    step = arms.select(F.col("key").alias("resolved"), F.col("same_as"))
    for _ in range(limit):
        moved = at.join(step, "resolved", "left").select("key", F.coalesce("same_as", "resolved").alias("resolved"), F.col("same_as").isNotNull().alias("more"))
        at = moved.select("key", "resolved")
        if not moved.where("more").head(1):
            return at
    raise ValueError("an alias chain is longer than the limit or has a cycle")


def frequencies(df: DataFrame, *by: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t__")))).withColumn("share", F.col("n") / F.col("t__")).drop("t__")  # one row


def size_histogram(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


def range_overlap(df: DataFrame, group: str, value: str) -> DataFrame:
    """For each pair of groups, whether their ranges meet."""
    g = df.groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    l, r = g.select(F.col(group).alias("a"), F.col("lo").alias("l1"), F.col("hi").alias("h1")), g.select(F.col(group).alias("b"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
    return l.join(r, F.col("a") < F.col("b")).select("a", "b", F.when(F.greatest("l1", "l2") > F.least("h1", "h2"), "DISJOINT").otherwise("OVERLAP").alias("verdict"))


def persistent(df: DataFrame, id: str, group: str) -> DataFrame:
    """Ids that occur in every group."""
    groups = df.agg(F.countDistinct(group).alias("groups"))
    return df.groupBy(id).agg(F.countDistinct(group).alias("k")).crossJoin(F.broadcast(groups)).where(F.col("k") == F.col("groups")).select(id)  # one row


def share_deviation(df: DataFrame, by: str, condition: Column) -> DataFrame:
    """Each group's share of the rows that meet a condition, less its share of all rows."""
    g = df.groupBy(by).agg(count_if(condition).alias("k"), F.count(F.lit(1)).alias("n"))
    t = g.agg(F.sum("k").alias("tk"), F.sum("n").alias("tn"))
    return g.crossJoin(F.broadcast(t)).select(by, (F.try_divide(F.col("k"), F.col("tk")) - F.col("n") / F.col("tn")).alias("deviation"))  # one row


def quantile_summary(df: DataFrame, value: str, floor: float) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.01), F.lit(0.05)))
    return df.agg(r6(F.avg(value)).alias("mean"), q.alias("q"), F.min(value).alias("lo"), r6(F.avg((F.col(value) < floor).cast("double"))).alias("below")).select(
        "mean", r6(F.get("q", F.lit(0))).alias("median"), "lo", r6(F.get("q", F.lit(1))).alias("q01"), r6(F.get("q", F.lit(2))).alias("q05"), "below"
    )


def pairwise_agreement(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean over pairs of columns of the share of equal rows, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return df.agg(r6(reduce(lambda x, y: x + y, [F.avg((F.col(a) == F.col(b)).cast("double")) for a, b in pairs]) / len(pairs)).alias("agreement"))


def numbered_groups(df: DataFrame, key: str) -> DataFrame:
    """1..k by sorted key: distinct keys are range-partitioned and numbered from their partitions' counts."""
    keys = df.select(key).distinct()
    h = keys.withColumn("p__", F.conv(F.substr(F.col(key), F.lit(1), F.lit(3)), 16, 10).cast("long"))
    first = running_sums(h.groupBy("p__").agg(F.count(F.lit(1)).alias("k__")), [], "p__", ["k__"], descending=False)
    inside = numbered(h, ["p__"], key, name="t__").join(first, "p__")
    return df.join(inside.select(key, (F.col("k___to") - F.col("k__") + F.col("t__")).cast("long").alias("number")), key)


def coverage(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """How many keys are missing from `found`, and how many are unexpected there."""
    e, f = expected.select(*keys).distinct().withColumn("e", F.lit(1)), found.select(*keys).distinct().withColumn("f", F.lit(1))
    return e.join(f, keys, "full_outer").agg(count_if(F.col("f").isNull()).alias("missing"), count_if(F.col("e").isNull()).alias("unexpected"))


def subsets(spark: SparkSession, n: int) -> DataFrame:
    """Non-empty subsets of n members as bit masks, with their size."""
    return spark.range(1, 1 << n).select(F.col("id").alias("subset"), F.bit_count("id").cast("long").alias("k"))


def leave_one_out(df: DataFrame, key: str, n: int) -> DataFrame:
    """df once for each of n members, without that member's rows."""
    return df.withColumn("dropped", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).where(F.col("dropped") != F.col(key))


def middle_row(df: DataFrame, by: list[str], value: str, id: str) -> DataFrame:
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n__"))
    return numbered(df, by, value, id, name="rn__").join(n, by).where(F.col("rn__") == F.floor(F.col("n__") / 2) + 1).drop("rn__", "n__")
