"""Ordered scoring of a stream of files: an extension, as batch scoring has no event time, watermarks or late data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def score_by_index(df: DataFrame, index: str, value: str, model: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(index, score) from a vectorised model; the order of results is the index, whatever order tasks end in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.asarray(model(x), float))], names=[index, "score"])

    return df.select(F.col(index).cast("long"), F.col(value).cast("double")).mapInArrow(run, f"{index} long, score double")


def score_stream(spark: SparkSession, source: str, schema: str, folder: str, checkpoint: str, index: str, value: str, model: Callable[[np.ndarray], np.ndarray], files_a_batch: int = 1):
    """Start scoring Parquet files as they arrive: each micro-batch is written under its own number, so a batch that is
    repeated after a failure replaces itself. Returns the StreamingQuery."""

    def write(batch: DataFrame, number: int) -> None:
        score_by_index(batch, index, value, model).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
