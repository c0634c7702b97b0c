"""Texts in blocks of bounded size, kept in a bucketed table so that later passes need no shuffle of them.

The operators that compare all texts ask questions about a block's features in buckets (of the features' hashes) and
get answers by block. A block is one row of packed texts; answers are joined to it by a co-group whose text side is
already bucketed by block.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import shared_dir, shuffle_parts
from .pitmanyor import pack, unpack
from .tokens import byte_slices

BLOCK = 12 << 20
LAST_ID = np.int64(2**63 - 1)  # stands for a null id


def text_blocks(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK, level: int = 1, carry: list[str] | None = None, buckets: int | None = None
) -> DataFrame:
    """A table of blocks: block, payload (ids, null marks of ids and of texts, lengths, bytes), rest. Written once.

    level is the compression's: a higher one trades CPU time for disk. rest holds the columns of `carry` as an Arrow
    stream, so that whole rows can be given back without a join; it is null without them.
    """
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, done = TaskContext.get().partitionId() << 24, 0
        ids: list[int | None] = []
        texts: list[bytes | None] = []
        rest: list[pa.RecordBatch] = []
        size = 0

        def close() -> pa.RecordBatch:
            numbers = np.array([LAST_ID if i is None else i for i in ids], "<i8")
            marks = np.array([(i is None) | (t is None) << 1 for i, t in zip(ids, texts, strict=True)], "<u1")
            lengths = np.array([len(t or b"") for t in texts], "<i8")
            payload = pack(numbers, marks, lengths, np.frombuffer(b"".join(t or b"" for t in texts), np.uint8), level=level)
            return pa.RecordBatch.from_arrays(
                [pa.array([base + done], pa.int64()), pa.array([payload], pa.binary()), pa.array([_stream(rest) if rest else None], pa.binary())], names=["block", "payload", "rest"]
            )

        for b in batches:
            values = b.column(1)
            at = 0
            while at < b.num_rows:
                some = values.slice(at, 2048).to_pylist()
                for lo, hi in byte_slices(some, 1 << 20):
                    ids += b.column(0).slice(at + lo, hi - lo).to_pylist()
                    texts += [None if t is None else t.encode("utf-8", "surrogatepass") for t in some[lo:hi]]
                    if carry:
                        rest.append(b.slice(at + lo, hi - lo).select(list(range(2, b.num_columns))))
                    size += sum(len(t or "") for t in some[lo:hi])
                    if size >= block_bytes:
                        yield close()
                        ids, texts, rest, size, done = [], [], [], 0, done + 1
                at += len(some)
        if ids:
            yield close()

    spark = docs.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    columns = [F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(carry)]]
    rows = docs.select(*columns).mapInArrow(run, "block long, payload binary, rest binary")
    rows.write.bucketBy(buckets or shuffle_parts(spark), "block").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(pa.Table.from_batches(batches).combine_chunks())
    return out.getvalue().to_pybytes()


class Texts:
    """An unpacked block."""

    def __init__(self, payload: bytes, rest: bytes | None = None):
        self._rest = rest
        self.ids, marks, self.lengths, self.bytes = unpack(payload)
        self.null_id, self.null_text = (marks & 1).astype(bool), (marks >> 1).astype(bool)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths

    def groups(self, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about `limit` bytes, one text at least."""
        lo = 0
        while lo < len(self.ids):
            hi = max(lo + 1, int(np.searchsorted(self.ends, self.starts[lo] + limit, "right")))
            yield lo, hi
            lo = hi

    def rest(self) -> list[pa.ChunkedArray]:
        """The carried columns."""
        return pa.ipc.open_stream(self._rest).read_all().columns

    def text(self, i: int) -> str | None:
        return None if self.null_text[i] else self.bytes[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "surrogatepass")

    def id_array(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.null_id)


QUESTION = "key long, block long, payload binary"


def question_rows(block: int, asks: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(asks), 64):
        some = asks[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array([block] * len(some), pa.int64()), pa.array([p for _, p in some], pa.binary())], names=["key", "block", "payload"])


def in_order(table: pa.Table, column: str) -> list[tuple[int, list[np.ndarray]]]:
    """(column's value, unpacked payload) of each row, by that value."""
    at = table.column(column).to_numpy()
    payload = table.column("payload")
    return [(int(at[i]), unpack(payload[int(i)].as_py())) for i in np.argsort(at, kind="stable")]


def answered(blocks: DataFrame, answers: DataFrame, body, schema: str | StructType) -> DataFrame:
    """body(block number, Texts, answers to it as a table) -> table, for every block, also where there are no answers."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return body(left.column("block")[0].as_py(), Texts(left.column("payload")[0].as_py(), left.column("rest")[0].as_py()), right)

    # The bucketed side isn't shuffled again.
    none = _none(schema) if isinstance(schema, str) else to_arrow_schema(schema).empty_table()
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda left, right: run(left, right) if left.num_rows else none, schema)


def _none(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.table({n: pa.array([], kinds[k]) for n, k in (x.split() for x in schema.split(", "))})
