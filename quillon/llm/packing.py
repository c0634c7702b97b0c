"""Vector bin packing of training sequences.

Every item is a vector of tokens, segments and loss-bearing tokens; a sequence has a limit on each. The open sequence
takes the item that fits and has the largest dot product with the room left in it (both scaled by the limits), so an
item is preferred that uses most of what the sequence has most of.

Sequences are filled within a task from a bounded pool of waiting items: no shuffle, and a lost task is recomputed
alone. Only a task's last sequence can stay short.

Defined cases: a null text is an empty one (its only id is the closing id); an empty table gives no piece; repeated
rows are packed as often as they occur; other columns are not read; a null loss or token count is 0; an example over a
limit gets a sequence of its own with `oversize` true.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import WordTokenizer, byte_slices

SEQUENCE = 2048
#: Production limits of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (SEQUENCE, 256, SEQUENCE)
POOL = 1024
END_ID = 1


class Packer:
    """Fills sequences from a pool of at most `pool` waiting items; `cut` allows items to be split.

    put(out) gets (sequence number, offset, key, start, length) of each piece.
    """

    def __init__(self, limits: tuple[int, int, int], put, *, pool: int = POOL, cut: bool = True):
        self.limits, self.put, self.pool, self.cut = np.array(limits, float), put, pool, cut
        self.max_tokens, self.max_segments, self.max_loss = limits
        self.tokens = np.zeros(pool, np.int64)
        self.loss = np.zeros(pool, np.int64)
        self.start = np.zeros(pool, np.int64)
        self.keys: list = [None] * pool
        self.n = self.sequence = 0

    def add(self, key, tokens: int, loss: int, start: int = 0) -> None:
        if self.n == self.pool:
            while self.n > self.pool // 2:
                self._fill()
        i = self.n
        self.tokens[i], self.loss[i], self.start[i], self.keys[i] = tokens, loss, start, key
        self.n += 1

    def _remove(self, i: int) -> None:
        self.n -= 1
        for a in (self.tokens, self.loss, self.start):
            a[i] = a[self.n]
        self.keys[i], self.keys[self.n] = self.keys[self.n], None

    def _fill(self) -> int:
        """Close one sequence; returns its tokens."""
        room, segments, loss, offset = self.max_tokens, self.max_segments, self.max_loss, 0
        while self.n and room and segments:
            t, ls = self.tokens[: self.n], self.loss[: self.n]
            fits = (t <= room) & (ls <= loss)
            if self.cut and segments == 1:  # the last segment has to fill what is left
                fits &= t == room
            score = np.where(fits, t * (room / self.max_tokens**2) + segments / self.max_segments**2 + ls * (loss / max(1, self.max_loss) ** 2), -1.0)
            i = int(score.argmax())
            if score[i] < 0:
                i = int(t.argmax())
                # Cutting is for documents, all of whose tokens bear loss.
                take = min(room, int(t[i])) if self.cut else 0
                if not take:
                    break
                self.put(self.sequence, offset, self.keys[i], int(self.start[i]), take)
                if take == self.tokens[i]:
                    self._remove(i)
                else:
                    self.tokens[i] -= take
                    self.loss[i] = max(0, self.loss[i] - take)
                    self.start[i] += take
            else:
                take = int(t[i])
                self.put(self.sequence, offset, self.keys[i], int(self.start[i]), take)
                loss -= int(ls[i])
                self._remove(i)
            room, segments, offset = room - take, segments - 1, offset + take
        self.sequence += 1
        return offset

    def flush(self) -> None:
        """Pack all that waits. With cutting, a last short sequence is dealt out over lengths that are powers of two."""
        while self.n:
            left = int(self.tokens[: self.n].sum())
            if self.cut and left < self.max_tokens:
                size = 1 << (left.bit_length() - 1)
                self.max_tokens, self.max_loss = size, max(self.max_loss, size)
            self._fill()


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id: str = "doc_id", text: str = "text", limits: tuple[int, int, int] = LIMITS, end_id: int = END_ID, with_ids: bool = False, pool: int = POOL
) -> DataFrame:
    """Pieces of all documents' ids (each document's ids end with end_id), cut and packed into sequences.

    A document's whole sequences come first; its remainder waits in the pool. With with_ids, each piece carries its ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        encoder = WordTokenizer(tokenizer_path)
        out: list[tuple] = []

        def put(sequence, offset, key, start, length):
            doc_id, ids, first, total = key
            piece = ids[start - first : start - first + length]
            row = (doc_id, start, length, zlib.crc32(piece.astype("<u4").tobytes()), total, base + sequence, offset)
            out.append((*row, piece) if with_ids else row)

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [()] * (7 + with_ids)
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([p.tolist() for p in columns[7]], pa.list_(pa.int32())))
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[*(x.split()[0] for x in PIECES.split(", ")), *["ids"] * with_ids])

        packer = Packer(limits, put, pool=pool)
        whole = min(limits[0], limits[2])
        for b in batches:
            ids_of, texts = b.column(0).to_pylist(), b.column(1)
            for lo, hi in byte_slices(texts.to_pylist(), 1 << 20):
                flat, counts = encoder.encode(texts.slice(lo, hi - lo).to_pylist())
                at = 0
                for doc_id, n in zip(ids_of[lo:hi], counts.tolist(), strict=True):
                    ids = np.append(flat[at : at + n], np.int32(end_id))
                    at += n
                    total, start = n + 1, 0
                    while total - start >= whole:
                        put(packer.sequence, 0, (doc_id, ids, 0, total), start, whole)
                        packer.sequence += 1
                        start += whole
                    if start < total:
                        packer.add((doc_id, ids[start:].copy(), start, total), total - start, total - start, start)
                if out:
                    yield batch()
        packer.flush()
        if out:
            yield batch()

    schema = PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, schema)


EXAMPLES = "example_id long, sequence_id long, offset long, tokens long, loss_tokens long, oversize boolean"


def pack_examples(
    examples: DataFrame, *, id: str = "example_id", tokens: str = "tokens", loss: str = "loss_tokens", limits: tuple[int, int, int] = LIMITS, pool: int = POOL
) -> DataFrame:
    """Place whole examples (instruction data) under the three limits; nothing is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        out: list[tuple] = []
        packer = Packer(limits, lambda s, offset, key, _, n: out.append((key[0], base + s, offset, n, key[1], False)), pool=pool, cut=False)
        names = [x.split()[0] for x in EXAMPLES.split(", ")]

        def batch() -> pa.RecordBatch:
            rows = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == "oversize" else pa.int64()) for n, c in zip(names, rows, strict=True)], names=names)

        for b in batches:
            for key, n, ls in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                n, ls = n or 0, ls or 0
                if n > limits[0] or ls > limits[2]:
                    out.append((key, base + packer.sequence, 0, n, ls, True))
                    packer.sequence += 1
                else:
                    packer.add((key, ls), n, ls)
            if out:
                yield batch()
        packer.flush()
        if out:
            yield batch()

    return examples.select(F.col(id).cast("long"), F.col(tokens).cast("long"), F.col(loss).cast("long")).mapInArrow(run, EXAMPLES)


def conversation_examples(turns: DataFrame, tokenizer_path: str, *, id: str = "conv_id", role: str = "role", text: str = "text", bearing: str = "assistant", end_id: bool = True) -> DataFrame:
    """example_id, tokens, loss_tokens of conversations: the ids of all turns (with an end each), and of the turns whose role
    bears loss. Null texts are empty turns; a null role bears none; turns without an id form one example with a null id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordTokenizer(tokenizer_path)
        for b in batches:
            for lo, hi in byte_slices(b.column(1).to_pylist(), 1 << 20):
                _, counts = encoder.encode(b.column(1).slice(lo, hi - lo).to_pylist())
                counts = counts + int(end_id)
                loss = np.where(np.asarray(b.column(2).slice(lo, hi - lo)), counts, 0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(counts), pa.array(loss)], names=["example_id", "tokens", "loss_tokens"])

    each = turns.select(F.col(id).cast("long"), F.col(text).cast("string"), F.coalesce(F.col(role) == bearing, F.lit(False)).alias("bears"))
    return each.mapInArrow(run, "example_id long, tokens long, loss_tokens long").groupBy("example_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))
