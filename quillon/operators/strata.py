"""Per-stratum rates, weights that equalise priors, and pair estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import count_if
from . import ranking as R
from .windows import numbered, running_sums


def kish(w: Column) -> Column:
    """Effective sample size of weights."""
    return F.try_divide(F.sum(w) * F.sum(w), F.sum(w * w))


def with_threshold(df: DataFrame, by: list[str], recall: float = R.RECALL, *, label: str = "label_int", score: str = "logit") -> DataFrame:
    """df with the attainable threshold of its group."""
    t = R.curve(df, by, label=label, score=score).groupBy(*by).agg(R.threshold(recall).alias("threshold"))
    return df.join(t, by) if by else df.crossJoin(F.broadcast(t))  # one row


def stratum_fpr(df: DataFrame, by: list[str], stratum: str, recall: float = R.RECALL, *, label: str = "label_int", score: str = "logit") -> DataFrame:
    """Rate of negatives at or above the group's one threshold in each stratum; asymmetry is null for a single stratum."""
    rows = with_threshold(df, by, recall, label=label, score=score)
    above = F.when(F.col(label) == 0, (F.col(score) >= F.col("threshold")).cast("double"))
    each = rows.groupBy(*by, stratum).agg(F.avg(above).alias("fpr"), F.max("threshold").alias("threshold"))
    whole = each.groupBy(*by).agg(F.when(F.count(F.lit(1)) > 1, F.max("fpr") - F.min("fpr")).alias("asymmetry"))
    return each.join(whole, by)


def prior_weights(df: DataFrame, stratum: str, *, label: str = "label_int") -> DataFrame:
    """Per stratum: counts, ratio of negatives to positives, and the weight that brings its negatives to the least ratio.

    Fewer than two strata, or a stratum without both classes, is an error.
    """
    n = df.groupBy(stratum).agg(count_if(F.col(label) == 1).alias("n_pos"), count_if(F.col(label) == 0).alias("n_neg"))
    both = F.min(F.least("n_pos", "n_neg"))
    anchor = n.agg(F.when((F.count(F.lit(1)) < 2) | (both == 0), F.raise_error(F.lit("prior equalisation needs two strata with both classes"))).otherwise(F.min(F.col("n_neg") / F.col("n_pos"))).cast("double").alias("target"))
    return n.crossJoin(F.broadcast(anchor)).select(stratum, "n_pos", "n_neg", (F.col("n_neg") / F.col("n_pos")).alias("ratio"), (F.col("target") * F.col("n_pos") / F.col("n_neg")).alias("weight"))  # one row


def prior_equalised(df: DataFrame, by: list[str], stratum: str, weights: DataFrame, recall: float = R.RECALL, *, label: str = "label_int", score: str = "logit") -> DataFrame:
    """Weighted rate of negatives above the unweighted threshold, with the weights' sum and effective size."""
    rows = with_threshold(df, by, recall, label=label, score=score).where(F.col(label) == 0).join(weights.select(stratum, "weight"), stratum)
    w = F.col("weight")
    return rows.groupBy(*by).agg((F.sum(F.when(F.col(score) >= F.col("threshold"), w).otherwise(0.0)) / F.sum(w)).alias("fpr"), F.sum(w).alias("effective_n"), kish(w).alias("kish"))


def restricted_pairs(df: DataFrame, *, max_fpr: float, pos_fraction: float, label: str = "label_int", score: str = "logit", id: str = "filepath", margin: float = 1.0) -> DataFrame:
    """Mean over the pairs of the lowest positives and the highest negatives: step (0.5 at ties) and squared hinge.

    The grid has ceil(pos_fraction * P) x ceil(max_fpr * N) pairs by definition. They are never built: both sums follow
    from the count, sum and sum of squares of the chosen negatives above each positive (less the margin).
    """
    n = df.agg(count_if(F.col(label) == 1).alias("p"), count_if(F.col(label) == 0).alias("q"))
    counted = df.crossJoin(F.broadcast(n))  # one row
    pos = numbered(counted.where(F.col(label) == 1), [], score, id).where(F.col("rn") <= F.ceil(F.lit(pos_fraction) * F.col("p"))).select(F.col(score).cast("double").alias("a"))
    neg = numbered(counted.where(F.col(label) == 0), [], f"-{score}", id).where(F.col("rn") <= F.ceil(F.lit(max_fpr) * F.col("q"))).select(F.col(score).cast("double").alias("b"))
    none = F.lit(0.0)
    weights = neg.groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("b").alias("s"), F.sum(F.col("b") * F.col("b")).alias("ss")).withColumn("own", F.lit(0))
    asked = lambda at: pos.groupBy(at.alias("v")).agg(none.alias("n"), none.alias("s"), none.alias("ss"), F.count(F.lit(1)).cast("int").alias("own"))
    above = lambda at: running_sums(weights.unionByName(asked(at)), [], "v", ["n", "s", "ss"]).where("own > 0")
    m = F.col("v")  # the positive less the margin: pairs above it break the margin
    broken = above(F.col("a") - margin).agg(F.sum(F.col("own") * (F.col("ss_to") - 2 * m * F.col("s_to") + m * m * F.col("n_to"))).alias("hinge"))
    tied = weights.select("v", F.col("n").alias("ties"))
    ranked = above(F.col("a")).join(tied, "v", "left").agg(F.sum(F.col("own") * (F.col("n_to") - F.coalesce("ties", none) / 2)).alias("lost"), F.sum("own").alias("k"))
    total = neg.agg(F.count(F.lit(1)).alias("chosen"))
    pairs = F.col("k") * F.col("chosen")
    one = ranked.crossJoin(F.broadcast(broken)).crossJoin(F.broadcast(total))  # one row each
    return one.select((1 - F.try_divide(F.col("lost"), pairs)).alias("step"), F.try_divide(F.col("hinge"), pairs).alias("hinge"), pairs.cast("long").alias("pairs"))
