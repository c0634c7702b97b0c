"""The prediction dump: a partitioned Parquet dataset with a fixed schema."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from .shared import shared_folder

#: Names and types, in order: the contract of the dump.
SCHEMA = [("filepath", "string"), ("centre", "string"), ("class_label", "string"), ("label_int", "bigint"), ("visibility", "string"), ("group_id_v2", "string"), ("repeat", "bigint"), ("fold", "bigint"), ("seed", "bigint"), ("logit", "double")]
PARTITIONS = ["repeat", "seed", "fold"]


def temporary_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/predictions-{uuid.uuid4().hex}"


def conformed(df: DataFrame) -> DataFrame:
    """The contract's columns, cast; fails on a missing column, and when computed on a score that isn't finite."""
    missing = [n for n, _ in SCHEMA if n not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    out = df.select(*[F.col(n).cast(t).alias(n) for n, t in SCHEMA])
    checked = F.when(finite(F.col("logit")), F.col("logit")).otherwise(F.raise_error(F.lit("a logit is not finite")).cast("double"))
    return out.withColumn("logit", checked)


def write_predictions(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    conformed(df).repartition(*PARTITIONS).write.mode(mode).partitionBy(*PARTITIONS).parquet(folder)


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.schema(", ".join(f"`{n}` {t}" for n, t in SCHEMA)).parquet(folder).select(*[n for n, _ in SCHEMA])
    if [(f.name, f.dataType.simpleString()) for f in df.schema] != SCHEMA:
        raise ValueError("the dump's schema differs from the contract")
    return df


def load_units(spark: SparkSession, folder: str, *, repeat: int, seed: int, folds: list[int]) -> DataFrame:
    """One scan of several units; only their partitions are read."""
    return read_predictions(spark, folder).where((F.col("repeat") == repeat) & (F.col("seed") == seed) & F.col("fold").isin(folds))
