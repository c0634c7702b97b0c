"""Pre-registered decision rules as column expressions over rows of medians and spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import count_if


def component_acceptance(pairs: DataFrame, by: list[str]) -> DataFrame:
    """pairs: a row a direction with treatment, control (lower is better), the two leave-one-out medians and spreads.

    Accepted if both directions improve and at least one by more than the larger spread. A null bar fails its condition.
    signs_agree (reported, not a condition): the medians tell the same sign in every direction.
    """
    gain, bar = F.col("control") - F.col("treatment"), F.greatest("iqr_treatment", "iqr_control")
    agree = (gain > 0) == (F.col("median_control") - F.col("median_treatment") > 0)
    g = pairs.groupBy(*by).agg(F.bool_and(F.coalesce(gain > 0, F.lit(False))).alias("both_improve"), F.bool_or(F.coalesce(gain > bar, F.lit(False))).alias("any_exceeds"), F.bool_and(agree).alias("signs_agree"))
    return g.withColumn("accepted", F.col("both_improve") & F.col("any_exceeds"))


def outcome_label(gain: Column, iqr_treatment: Column, iqr_control: Column) -> Column:
    """The bar is the larger of both arms' spreads."""
    return F.when(gain > F.greatest(iqr_treatment, iqr_control), "PASS").when(gain > 0, "improved, under IQR").when(gain == 0, "no change").otherwise("WORSE")


def gate_with_veto(gain: Column, bar: Column, regress: Column, own_bar: Column) -> Column:
    """The pooled gain exceeds its bar and no direction regresses by more than its own."""
    return F.coalesce(gain > bar, F.lit(False)) & ~F.coalesce(regress > own_bar, F.lit(False))


def rule_with_missing(gain: Column, bar: Column, holdout_regresses: Column) -> Column:
    """Null where the holdout is missing."""
    return F.when(holdout_regresses.isNull(), F.lit(None).cast("boolean")).otherwise((gain > bar) & ~holdout_regresses)


def paired_sign(deltas: DataFrame, by: list[str], need: int = 4, *, seed: str = "seed") -> DataFrame:
    """Paired deltas: accepted if the median is above 0 and at least `need` deltas are on its side of 0.

    A delta of 0 is not above 0. A positive median with too few deltas on its side is ambiguous while only one seed
    has been run, and otherwise fails like a median that isn't positive.
    """
    g = deltas.groupBy(*by).agg(F.percentile("delta", F.lit(0.5)).alias("median"), count_if(F.col("delta") > 0).alias("up"), F.count(F.lit(1)).alias("n"), F.countDistinct(seed).alias("seeds"))
    same = F.when(F.col("median") > 0, F.col("up")).otherwise(F.col("n") - F.col("up"))
    verdict = F.when((F.col("median") > 0) & (same >= need), "accept").when((F.col("median") > 0) & (F.col("seeds") == 1), "ambiguous").otherwise("reject")
    return g.withColumn("same_sign", same).withColumn("verdict", verdict)


def headline(rows: DataFrame, by: list[str]) -> DataFrame:
    """YES if any row regressed, NO if none did and one improved resolvably, else INCONCLUSIVE."""
    return rows.groupBy(*by).agg(F.bool_or("regressed").alias("r"), F.bool_or("improved").alias("i")).select(*by, F.when(F.col("r"), "YES").when(F.col("i"), "NO").otherwise("INCONCLUSIVE").alias("headline"))


def nearest_reference(value: Column, a: float, b: float) -> Column:
    return F.when(F.abs(value - a) < F.abs(value - b), "a").when(F.abs(value - a) > F.abs(value - b), "b").otherwise("tie")


def floor_rule(arms: DataFrame, control: str, *, arm: str = "arm", ppv_floor: float = 0.0518, fpr_ceiling: float = 0.0898) -> DataFrame:
    """arms: arm, ppv, fpr. Every other arm's differences from the control, and whether it passes both limits."""
    base = arms.where(F.col(arm) == control).select(F.col("ppv").alias("ppv0"), F.col("fpr").alias("fpr0"))
    out = arms.where(F.col(arm) != control).crossJoin(F.broadcast(base))  # one row
    out = out.select(arm, (F.col("ppv") - F.col("ppv0")).alias("delta_ppv"), (F.col("fpr") - F.col("fpr0")).alias("delta_fpr"))
    return out.withColumn("accepted", (F.col("delta_ppv") > ppv_floor) & (F.col("delta_fpr") <= fpr_ceiling))


def sanity_band(median: Column, low: float, high: float, reference: Column, factor: float = 0.8) -> Column:
    return median.between(low, high) & (median < reference * factor)
