"""Ensembles, fusion of arms and subset families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import aligned_join
from .windows import mid_rank, zscore


def mean_ensemble(df: DataFrame, id: list[str], score: str, members: int, *, member: str = "seed") -> DataFrame:
    """Mean score of each id over its members; an id that lacks a member is an error when computed."""
    g = df.groupBy(*id).agg(F.avg(score).alias(score), F.countDistinct(member).alias("k__"))
    return g.withColumn(score, F.when(F.col("k__") == members, F.col(score)).otherwise(F.raise_error(F.lit("an id lacks a member")).cast("double"))).drop("k__")


def subset_ensembles(df: DataFrame, id: list[str], score: str, members: int, *, member: str = "seed") -> DataFrame:
    """(subset, k, id, score): the mean over every subset of the members, given as a bit mask.

    Each id's scores meet once in a row of `members` values; the subsets' means are computed there.
    """
    wide = df.groupBy(*id).agg(*[F.avg(F.when(F.col(member) == i, F.col(score))).alias(f"m{i}__") for i in range(members)])
    rows = wide.withColumn("subset", F.explode(F.sequence(F.lit(1).cast("long"), F.lit((1 << members) - 1).cast("long"))))
    on = [F.shiftright("subset", i).bitwiseAND(F.lit(1)) for i in range(members)]
    # Members that an id lacks are left out, as in a mean over its rows.
    total = sum((F.when((b == 1) & F.col(f"m{i}__").isNotNull(), F.col(f"m{i}__")).otherwise(0.0) for i, b in enumerate(on)), F.lit(0.0))
    have = sum((F.when((b == 1) & F.col(f"m{i}__").isNotNull(), 1).otherwise(0) for i, b in enumerate(on)), F.lit(0))
    return rows.where(have > 0).select("subset", F.bit_count("subset").cast("int").alias("k"), *id, (total / have).alias(score))


def fuse(a: DataFrame, b: DataFrame, id: str, how: str = "logit", *, label: str = "label_int") -> DataFrame:
    """Mean of two arms' scores as they are, as z-scores, or as mid-ranks; strictly aligned."""
    as_is = lambda df: df.withColumn("f", F.col("logit"))
    form = {"logit": as_is, "zscore": lambda df: zscore(df.withColumn("one__", F.lit(1)), ["one__"], "logit", "f"), "rank": lambda df: mid_rank(df, [], "logit", "f")}[how]
    j = aligned_join(form(a).select(id, label, "f"), form(b).select(id, label, "f"), [id], label)
    return j.select(id, F.col(f"{label}_a").alias(label), ((F.col("f_a") + F.col("f_b")) / 2).alias("fused"))


def exponential_average(values: Column, decay: float) -> Column:
    """The last value of shadow = decay * shadow + (1 - decay) * x over an array, from its first element."""
    return F.aggregate(F.slice(values, 2, F.size(values)), F.get(values, F.lit(0)), lambda s, x: decay * s + (1 - decay) * x)
