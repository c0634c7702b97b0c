"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_twins(df: DataFrame, folder: str) -> None:
    """The same rows as Parquet and as CSV with a header."""
    df.write.mode("overwrite").parquet(f"{folder}/data.parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/data.csv")


def append_json_lines(df: DataFrame, folder: str) -> None:
    df.write.mode("append").json(folder)


def write_report(df: DataFrame, folder: str) -> None:
    """Nested rows as JSON."""
    df.write.mode("overwrite").json(folder)


def latest_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert semantics: of each key, the row with the largest `order`."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.max_by(whole, order).alias("r__")).select("r__.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
