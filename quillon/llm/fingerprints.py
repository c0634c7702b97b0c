"""Quartile bucket digests of documents.

A digest counts the hashed byte triplets of a text in 256 buckets and writes, for each bucket, which quartile of the
256 counts it lies in, after a code of the text's length and of the quartiles' ratios. Two digests are compared by a
difference score that has an upper bound.

Defined cases: a null text is an empty one; texts of under three bytes have all-zero buckets; equal texts have equal
digests; rows with the same id are ordered by their text; one document is its own successor; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 256


def _shuffled(multiplier: int) -> np.ndarray:
    """A permutation of the 256 byte values from a multiplicative rule."""
    return np.argsort((np.arange(1, 257, dtype=np.uint64) * np.uint64(multiplier)) & np.uint64(0xFFFFFFFF), kind="stable").astype(np.uint8)


_FIRST, _SECOND, _THIRD = (_shuffled(m) for m in (2654435761, 2246822519, 3266489917))
#: Steps between two bucket codes count 1, 2 and 6: opposite quartiles weigh double.
_STEP = np.array([0, 1, 2, 6], np.int64)
#: The score's bound: about what the digests of unrelated texts differ by.
MAX_DIFFERENCE = 450


def digest(data: bytes) -> str:
    """Hex: 2 digits of the logarithm of the length, 2 of the quartiles' ratios, then 2 bits a bucket."""
    b = np.frombuffer(data, np.uint8)
    if len(b) >= 3:
        counts = np.bincount(_FIRST[b[:-2]] ^ _SECOND[b[1:-1]] ^ _THIRD[b[2:]], minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
    ranked = np.sort(counts)
    q1, q2, q3 = (int(ranked[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(math.log1p(len(data)) / math.log(1.1)))
    ratios = (16 * q1 // max(1, q3)) % 16 * 16 + (16 * q2 // max(1, q3)) % 16
    quads = codes.reshape(-1, 4)
    body = quads[:, 0] << 6 | quads[:, 1] << 4 | quads[:, 2] << 2 | quads[:, 3]
    return f"{length:02x}{ratios:02x}{body.tobytes().hex()}"


def _codes(d: str) -> np.ndarray:
    b = np.frombuffer(bytes.fromhex(d[4:]), np.uint8)
    return np.stack([b >> 6, b >> 4 & 3, b >> 2 & 3, b & 3], 1).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """From 0 (equal digests) to MAX_DIFFERENCE."""
    if a == b:
        return 0
    length = abs(int(a[:2], 16) - int(b[:2], 16))
    turns = [abs(int(a[i], 16) - int(b[i], 16)) for i in (2, 3)]
    header = min(length, 24) // 2 + sum(min(t, 16 - t) for t in turns)
    body = int(_STEP[np.abs(_codes(a) - _codes(b))].sum())
    return min(MAX_DIFFERENCE, header + body)


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / MAX_DIFFERENCE


def fingerprint(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the digest of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [digest((t or "").encode("utf-8", "surrogatepass")) for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


RESULT = [
    ("doc_id", pa.int64(), "long"),
    ("n_chars", pa.int64(), "long"),
    ("edited_sha256", pa.string(), "string"),
    ("fingerprint", pa.string(), "string"),
    ("edited_fingerprint", pa.string(), "string"),
    ("near_edited", pa.float64(), "double"),
    ("near_next", pa.float64(), "double"),
]
_NAMES = [n for n, _, _ in RESULT]
_SCHEMA = ", ".join(f"{n} {s}" for n, _, s in RESULT)


def edited_text(text: str, following: str) -> str:
    """The last quarter of text's code points gives way to as many of the following text's first (or all it has)."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compare(doc_id, text: str, own: str, following: str, following_digest: str) -> tuple:
    edited = edited_text(text, following).encode("utf-8", "surrogatepass")
    changed = digest(edited)
    return doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, following_digest)


def _print(text: str) -> str:
    return digest(text.encode("utf-8", "surrogatepass"))


def compare_with_next(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's digest against that of its edited text and of the next document by id.

    One range exchange brings neighbours together. A task answers for all its documents but the last, whose neighbour
    is the first of the next non-empty task; those two texts a task are matched afterwards by a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        before = None  # id, text, digest

        def rows(out: list[tuple], edge: list[tuple]) -> pa.RecordBatch:
            """edge: (kind, id, text) of the first and of the last document."""
            columns = list(zip(*out, strict=True)) if out else [()] * len(RESULT)
            arrays = [pa.array([*c, *([e[1] for e in edge] if n == "doc_id" else [None] * len(edge))], t) for c, (n, t, _) in zip(columns, RESULT, strict=True)]
            arrays += [pa.array([0] * len(out) + [e[0] for e in edge], pa.int32()), pa.array([part] * (len(out) + len(edge)), pa.int32()), pa.array([None] * len(out) + [e[2] for e in edge], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, names=[*_NAMES, "kind", "part", "text"])

        for b in batches:
            for lo in range(0, b.num_rows, 512):
                piece, out, edge = b.slice(lo, 512), [], []
                for doc_id, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    t = t or ""
                    own = _print(t)
                    if before is None:
                        edge.append((1, doc_id, t))
                    else:
                        out.append(_compare(*before, t, own))
                    before = (doc_id, t, own)
                yield rows(out, edge)
        if before is not None:
            yield rows([], [(2, *before[:2])])

    ordered = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = staged(ordered.mapInArrow(run, f"{_SCHEMA}, kind int, part int, text string"), "fingerprints", ["kind"])
    firsts = found.where("kind = 1").select("part", F.col("doc_id").alias("at"), F.col("text").alias("following"))
    # One row a task, not a document.
    order = [r.part for r in firsts.select("part", "at").orderBy(F.col("at").asc_nulls_first()).collect()]
    pairs = docs.sparkSession.createDataFrame(list(zip(order, [*order[1:], *order[:1]], strict=True)), "part int, next_part int")
    lasts = found.where("kind = 2").select("part", "doc_id", "text").join(pairs, "part")
    edges = lasts.join(firsts.select(F.col("part").alias("next_part"), "following"), "next_part").select("doc_id", "text", "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_compare(d, t, _print(t), f, _print(f)) for d, t, f in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            columns = list(zip(*out, strict=True)) if out else [()] * len(RESULT)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t, _) in zip(columns, RESULT, strict=True)], names=_NAMES)

    return found.where("kind = 0").select(*_NAMES).unionByName(edges.mapInArrow(finish, _SCHEMA))
