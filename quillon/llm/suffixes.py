"""Removal of passages that repeat across documents, by distributed prefix doubling.

Positions of all texts get ranks (names) of the strings that start there, of growing length; a position leaves as soon
as its string is unique to one document, and the doubling ends at the threshold:

1. Rank by a string of half the threshold. Not every position takes part: each window of `threshold` bytes is
   represented by the smallest (by hash) of the strings of 25 bytes that start in its first 26 positions. Equal windows
   have equal representatives, so a window whose representative occurs in no second document is unique and leaves.
   Neighbouring windows mostly share theirs; about two ranks in 27 positions are exchanged.
2. For the windows that are left, the ranks of the two halves at i and i + 25 form pairs; they are sorted and ranked
   anew within their representative's bucket. Equal ranks are now equal strings of 50 bytes, and the least document id
   of each is known.

Half strings are named by 64-bit hashes; two strings are taken for equal only if both halves' hashes and the
representative's agree. Ranks are names, not lexicographic places, which deduplication has no use for.

A block (of about 4 MB of texts) asks at most once for each distinct string, with its least document id, so a passage
that a third of all documents share is one row a block. Texts are written once and not shuffled.

Defined cases: null and empty texts have no bytes, nothing is removed from texts shorter than the threshold; a null id
counts as larger than all others; rows with equal ids do not remove each other's bytes; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import QUESTION, Texts, answered, in_order, question_rows, text_blocks
from .common import shuffle_parts, staged
from .pitmanyor import pack

THRESHOLD = 50
BLOCK = 4 << 20  # bytes of text; all windows of a block may repeat
BUCKETS = 8  # a shuffle partition
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def window_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each string of `size` bytes in data, mixed."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[size:] - sums[: n - size + 1]) * down[: n - size + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


class Runs:
    """The windows of a block: runs of neighbouring windows of one document with one representative."""

    def __init__(self, texts: Texts, threshold: int):
        half = threshold // 2
        keys, docs, starts, counts = [], [], [], []
        for lo, hi in texts.groups():
            at, end = int(texts.starts[lo]), int(texts.ends[hi - 1])
            h = window_hashes(texts.bytes[at:end], half)
            if len(h) < threshold - half + 1:
                continue
            least = _sliding_min(h, threshold - half + 1)
            doc = np.repeat(np.arange(lo, hi), texts.lengths[lo:hi])[: len(least)]
            inside = texts.ends[doc] - at - np.arange(len(least)) >= threshold
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
            first = np.flatnonzero(new & inside)
            stop = np.flatnonzero(np.append((new | ~inside)[1:], True)) + 1
            keys.append(least[first])
            docs.append(doc[first])
            starts.append(first + at)
            counts.append(stop[np.searchsorted(stop, first, "right")] - first)
        join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
        self.key, self.doc, self.start, self.count = join(keys, np.uint64), join(docs, np.int64), join(starts, np.int64), join(counts, np.int64)


def _by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the keys by bucket, then key; and where each bucket starts."""
    bucket = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _ask_ranks(texts: Texts, buckets: int, threshold: int) -> tuple[Runs, np.ndarray, np.ndarray, np.ndarray]:
    """The runs, the distinct keys in the order asked, each bucket's start, and each run's place in that order."""
    runs = Runs(texts, threshold)
    distinct, back = np.unique(runs.key, return_inverse=True)
    order, starts = _by_bucket(distinct, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return runs, distinct[order], starts, place[back]


def _answer_ranks(table: pa.Table) -> pa.Table:
    """For each block, which of its keys another block has too."""
    asked = in_order(table, "block")
    keys = np.concatenate([low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) for _, (low, high) in asked])
    _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    shared, at, rows = n[back] > 1, 0, []
    for block, (low, _) in asked:
        rows.append((block, pack(np.packbits(shared[at : at + len(low)]))))
        at += len(low)
    key = table.column("key")[0].as_py()
    return pa.table({"key": pa.array([key] * len(rows), pa.int64()), "block": pa.array([b for b, _ in rows], pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})


def _shared_runs(texts: Texts, answers: list[tuple[int, list[np.ndarray]]], buckets: int, threshold: int) -> Runs:
    """The runs whose representative occurs in a second document."""
    runs, keys, starts, place = _ask_ranks(texts, buckets, threshold)
    shared = np.zeros(len(keys), bool)
    for bucket, (bits,) in answers:
        lo, hi = starts[bucket], starts[bucket + 1]
        shared[lo:hi] = np.unpackbits(bits)[: hi - lo]
    ids = texts.ids[runs.doc]
    least, most = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), np.iinfo(np.int64).min)
    np.minimum.at(least, place, ids)
    np.maximum.at(most, place, ids)
    keep = (shared | (least < most))[place]
    for name in ("key", "doc", "start", "count"):
        setattr(runs, name, getattr(runs, name)[keep])
    return runs


def _strings(texts: Texts, runs: Runs, buckets: int, threshold: int):
    """The distinct strings of the runs in the order asked: each run's string number, and of each string the bytes, key and least id."""
    seen: dict[tuple[int, bytes], int] = {}
    which = np.empty(len(runs.key), np.int64)
    data = texts.bytes.tobytes()
    for i, (key, s, n) in enumerate(zip(runs.key.tolist(), runs.start.tolist(), runs.count.tolist(), strict=True)):
        which[i] = seen.setdefault((key, data[s : s + n + threshold - 1]), len(seen))
    keys = np.fromiter((k for k, _ in seen), np.uint64, len(seen))
    order, starts = _by_bucket(keys, buckets)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    which = place[which]
    strings = [s for _, s in seen]
    least = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(least, which, texts.ids[runs.doc])
    return which, [strings[i] for i in order], keys[order], starts, least


def _answer_windows(table: pa.Table, threshold: int) -> pa.Table:
    """For each block's strings, which windows occur in a document with a smaller id: pairs of half ranks, ranked anew."""
    half = threshold // 2
    asked = in_order(table, "block")
    keys, ids, sizes, data = (np.concatenate([a[k] for _, a in asked]) for k in range(4))
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    _, rank = np.unique(window_hashes(data, half), return_inverse=True)
    windows = sizes - threshold + 1
    owner = np.repeat(np.arange(len(sizes)), windows)
    at = np.arange(len(owner)) + np.repeat((ends - sizes) - (np.cumsum(windows) - windows), windows)
    pair = rank[at].astype(np.int64) << 32 | rank[at + threshold - half]
    ids = ids[owner]
    order = np.lexsort((ids, pair, keys[owner]))
    new = np.ones(len(order), bool)
    new[1:] = (pair[order][1:] != pair[order][:-1]) | (keys[owner][order][1:] != keys[owner][order][:-1])
    least = ids[order][new][np.cumsum(new) - 1]
    again = np.zeros(len(order), bool)
    again[order] = ids[order] > least
    rows, done, strings = [], 0, 0
    for block, (k, *_) in asked:
        n = int(windows[strings : strings + len(k)].sum())
        rows.append((block, pack(np.packbits(again[done : done + n]))))
        done, strings = done + n, strings + len(k)
    key = table.column("key")[0].as_py()
    return pa.table({"key": pa.array([key] * len(rows), pa.int64()), "block": pa.array([b for b, _ in rows], pa.int64()), "payload": pa.array([p for _, p in rows], pa.binary())})


def repeated_bytes(texts: Texts, first: list, second: list, buckets: int, threshold: int) -> np.ndarray:
    """A mark for each byte of the block that a repeated window covers."""
    runs = _shared_runs(texts, first, buckets, threshold)
    which, strings, _, starts, least = _strings(texts, runs, buckets, threshold)
    windows = np.fromiter((len(s) - threshold + 1 for s in strings), np.int64, len(strings))
    upto = np.concatenate([[0], np.cumsum(windows)])
    flags = np.zeros(int(upto[-1]), bool)
    for bucket, (bits,) in second:
        lo, hi = upto[starts[bucket]], upto[starts[bucket + 1]]
        flags[lo:hi] = np.unpackbits(bits)[: hi - lo]
    later = texts.ids[runs.doc] > least[which]  # the same string stands in this block under a smaller id
    hit = np.zeros(len(texts.bytes) + 1, bool)
    for lo in range(0, len(which), 1 << 15):  # runs in slices: arrays over all windows would be large
        n, w = runs.count[lo : lo + (1 << 15)], which[lo : lo + (1 << 15)]
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        again = flags[np.repeat(upto[w], n) + at] | np.repeat(later[lo : lo + (1 << 15)], n)
        hit[(np.repeat(runs.start[lo : lo + (1 << 15)], n) + at)[again]] = True
    begun = np.cumsum(hit[:-1], dtype=np.int32)
    removed = begun > 0
    removed[threshold:] = begun[threshold:] > begun[:-threshold]
    return removed


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
KEPT = "doc_id long, text string, n_removed long, n_spans long"


def _deduplicated(docs: DataFrame, body, schema: str | StructType, *, id: str, text: str, threshold: int, carry: list[str] | None = None) -> DataFrame:
    if threshold < 2 or threshold % 2:
        raise ValueError("the threshold is an even number of bytes")
    spark = docs.sparkSession
    buckets = shuffle_parts(spark) * BUCKETS
    blocks = text_blocks(docs, id=id, text=text, block_bytes=BLOCK, carry=carry)

    def ask_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                _, keys, starts, _ = _ask_ranks(Texts(payload.as_py()), buckets, threshold)
                keys = keys >> np.uint64(16)  # 48 bits and the bucket: a false match costs a comparison, no more
                low, high = (keys & np.uint64(0xFFFFFFFF)).astype("<u4"), (keys >> np.uint64(32)).astype("<u2")
                yield from question_rows(block, [(k, pack(low[a:e], high[a:e])) for k, (a, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)) if a < e])

    first = staged(blocks.mapInArrow(ask_ranks, QUESTION).groupBy("key").applyInArrow(_answer_ranks, QUESTION), "suffix-ranks")

    def ask_windows(block: int, texts: Texts, answers: pa.Table) -> pa.Table:
        runs = _shared_runs(texts, in_order(answers, "key"), buckets, threshold)
        _, strings, keys, starts, least = _strings(texts, runs, buckets, threshold)
        asks = []
        for k, (a, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
            if a < e:
                sizes = np.fromiter(map(len, strings[a:e]), "<u4", e - a)
                asks.append((k, pack(keys[a:e], least[a:e], sizes, np.frombuffer(b"".join(strings[a:e]), np.uint8))))
        return pa.table({"key": pa.array([k for k, _ in asks], pa.int64()), "block": pa.array([block] * len(asks), pa.int64()), "payload": pa.array([p for _, p in asks], pa.binary())})

    asked = answered(blocks, first, ask_windows, QUESTION)
    second = staged(asked.groupBy("key").applyInArrow(lambda t: _answer_windows(t, threshold), QUESTION), "suffix-windows")
    both = first.select("block", "key", "payload", F.lit(1).alias("step")).unionByName(second.select("block", "key", "payload", F.lit(2).alias("step")))

    def finish(block: int, texts: Texts, answers: pa.Table) -> pa.Table:
        step = answers.column("step").to_numpy() if answers.num_rows else np.zeros(0, int)
        take = lambda k: in_order(answers.filter(pa.array(step == k)), "key")
        return body(texts, repeated_bytes(texts, take(1), take(2), buckets, threshold))

    return answered(blocks, both, finish, schema)


def _spans(texts: Texts, removed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Removed bytes and removed runs of each text."""
    starts = np.append(texts.starts, len(removed))
    counts = np.concatenate([[0], np.cumsum(removed)])
    edge = removed.copy()
    edge[1:] &= ~removed[:-1]
    real = texts.starts[texts.lengths > 0]
    edge[real] = removed[real]  # a text's first byte begins a run of its own
    edges = np.concatenate([[0], np.cumsum(edge)])
    return np.diff(counts[starts]), np.diff(edges[starts])


def removal_digests(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """Per document: its bytes, the removed bytes and runs, and the SHA-256 of what is left."""

    def body(texts: Texts, removed: np.ndarray) -> pa.Table:
        gone, spans = _spans(texts, removed)
        digests = [hashlib.sha256(texts.bytes[a:e][~removed[a:e]].tobytes()).hexdigest() for a, e in zip(texts.starts.tolist(), texts.ends.tolist(), strict=True)]
        return pa.table({"doc_id": texts.id_array(), "n_bytes": pa.array(texts.lengths), "n_removed": pa.array(gone), "n_spans": pa.array(spans), "kept_sha256": pa.array(digests)})

    return _deduplicated(docs, body, DIGEST, id=id, text=text, threshold=threshold)


def remove_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc_id and the text without its repeated bytes (null stays null; a character that is cut apart goes with them)."""

    def body(texts: Texts, removed: np.ndarray) -> pa.Table:
        gone, spans = _spans(texts, removed)
        kept = [None if null else texts.bytes[a:e][~removed[a:e]].tobytes().decode("utf-8", "ignore") for a, e, null in zip(texts.starts.tolist(), texts.ends.tolist(), texts.null_text.tolist(), strict=True)]
        return pa.table({"doc_id": texts.id_array(), "text": pa.array(kept, pa.string()), "n_removed": pa.array(gone), "n_spans": pa.array(spans)})

    return _deduplicated(docs, body, KEPT, id=id, text=text, threshold=threshold)


_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def deduplicated_rows(docs: DataFrame, *, id: str = "doc_id", text: str = "text", chars: str = "n_chars", threshold: int = THRESHOLD) -> DataFrame:
    """docs' own rows and columns with the repeated bytes removed from the text; rows whose text is left without a word go.

    Untouched rows stay as they are. Rows are told apart by their place, so repeated and null ids keep their own texts.
    The column `chars`, where there is one, gets the new number of characters of changed texts. Documents are packed
    with all their columns, so nothing is joined back.
    """
    carry = [c for c in docs.columns if c != text]

    def body(texts: Texts, removed: np.ndarray) -> pa.Table:
        gone, _ = _spans(texts, removed)
        columns, keep, kept, lengths = dict(zip(carry, texts.rest(), strict=True)), [], [], {}
        for i, (a, e, n) in enumerate(zip(texts.starts.tolist(), texts.ends.tolist(), gone.tolist(), strict=True)):
            if not n:
                keep.append(i)
                kept.append(texts.text(i))
                continue
            left = texts.bytes[a:e][~removed[a:e]].tobytes()
            if _WORD.search(left):
                keep.append(i)
                kept.append(left.decode("utf-8", "ignore"))
                lengths[i] = len(kept[-1])
        columns[text] = pa.array(kept, pa.string())
        at = pa.array(keep, pa.int64())
        for c in carry:
            columns[c] = columns[c].take(at)
        if chars in carry and lengths:
            old = columns[chars]
            columns[chars] = pa.array([lengths.get(i, v) for i, v in zip(keep, old.to_pylist(), strict=True)], old.type)
        return pa.table({c: columns[c] for c in docs_columns})

    docs_columns = docs.columns
    return _deduplicated(docs, body, docs.schema, id=id, text=text, threshold=threshold, carry=carry)
