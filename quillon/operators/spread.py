"""Summaries of a set of values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Of the finite values: n, median, iqr, q1, q3, lo, hi, width, sd (sample; 0 for one value). All null if there is none."""
    v = F.when(finite(F.col(value).cast("double")), F.col(value).cast("double"))
    out = df.groupBy(*by).agg(F.count(v).alias("n"), F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"), F.stddev_samp(v).alias("sd"))
    q = lambda i: F.get("q", F.lit(i))
    sd = F.when(F.col("n") == 1, 0.0).otherwise(F.col("sd"))
    return out.select(*by, "n", q(1).alias("median"), (q(2) - q(0)).alias("iqr"), q(0).alias("q1"), q(2).alias("q3"), "lo", "hi", (F.col("hi") - F.col("lo")).alias("width"), sd.alias("sd"))


def noise_floor(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """spread, with the range as the smallest effect that can be told from noise (mde)."""
    return spread(df, by, value).withColumn("mde", F.col("width"))
