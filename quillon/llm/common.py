"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: The characters that separate words everywhere in this subpackage: [\x20\x09-\x0D].
WORD_BREAKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    return shared_folder(spark)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df once as a table in the shared folder and read it back; this cuts the lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that nothing refers to any more (it does so when garbage is collected)."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Meanwhile planned rows go to Python in Arrow batches of some `size` bytes, a group's too; Spark keeps a batch's buffers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def let(value: Column, body) -> Column:
    """Bind value once inside an expression: body gets it as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words [^\\x20\\x09-\\x0D]+ as UTF-8; bytes.lower and bytes.split act on just these ASCII characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
