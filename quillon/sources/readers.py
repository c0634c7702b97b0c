"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet for paths that end so, otherwise CSV with a header; CSV needs a schema, so that no pass infers it."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if schema is None:
        raise ValueError("a CSV file is read with an explicit schema")
    return spark.read.schema(schema).option("header", True).csv(path)


def read_images(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg,tif,tiff,bmp}") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines are kept in `_corrupt_record`, with nulls elsewhere."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row a file."""
    return spark.read.option("wholetext", True).text(path)
