"""SentencePiece encoding and decoding by a relational lattice.

A text's spaces become word marks and a mark precedes it. No piece crosses the start of a run of marks, so a text is a
sequence of words that are encoded each by itself, a block's distinct words once:

1. Texts are read once, in blocks. A block asks for each of its distinct words in the bucket of the word's hash; its texts
   are kept as places among these words. A bucket takes the distinct words of all blocks, so a word is encoded once in
   the corpus and a frequent word makes no hot bucket.
2. A word's substrings of up to the longest piece's length are exploded and equi-joined to the piece table; a character
   that no piece covers is spelled in bytes. This happens where the bucket is: words and edges aren't shuffled, and a
   word's edges leave the join one after another.
3. The edges are folded. For a unigram model the fold is Viterbi's, by Spark's `aggregate`: best score and last edge of
   every position, then a walk back. The pieces of a BPE model carry merge ranks, and the path of the largest score sum
   is not what merging gives (it agrees on under half of the words). For such a model the edges are folded once, by
   rank and start, over the set of cuts, for many words at a time: an edge whose ends are cuts with one cut between them
   removes that one. A piece is made of pieces of better ranks, so this order is the merges' own; tests hold it against
   the library.
4. A bucket answers every block's words in the order asked, and each block puts its texts' ids together.

Defined cases: null and empty texts have no pieces; the piece table's size is the model's and doesn't grow with the
input; texts need the identity normalisation (the model's own is not applied); words of more than MAX_WORD characters
are encoded by the library, as the fold's cost on long words is their square; repeated rows are encoded each; a null id
stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import released, shuffle_parts
from .pitmanyor import ROW, _bucketed, _row, pack, unpack
from .tokens import byte_slices

MARK = "▁"
MAX_WORD = 2000
SHORT = 61  # characters of a word whose cuts fit a long
BLOCK = 12 << 20  # characters of text
FOLD = 400_000  # edges that are folded at once
SPELL = 50_000  # words that are spelled at once
UNKNOWN_SCORE = -1e9  # of a character that is spelled in bytes
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


class PieceModel:
    """The pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = m.get_piece_size()
        plain = [i for i in range(self.size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.pieces = {i: m.id_to_piece(i) for i in plain}
        self.scores = {i: float(m.get_score(i)) for i in plain}
        self.bytes = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if self.bytes != list(range(self.bytes[0], self.bytes[0] + 256)):
            raise ValueError("the byte pieces aren't consecutive")
        self.longest = max(map(len, self.pieces.values()))
        # A BPE model's scores are its negated merge ranks in the order of ids (or far below, for pieces of no merge).
        self.merges = all(s <= UNKNOWN_SCORE or s == plain[0] - i for i, s in self.scores.items())

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, score, merge rank (equal scores have equal ranks): as many rows as the model has pieces."""
        rank = {v: k for k, v in enumerate(sorted({-v for v in self.scores.values()}))}
        rows = [(p, i, self.scores[i], rank[-self.scores[i]]) for i, p in self.pieces.items()]
        return spark.createDataFrame(rows, "piece string, id int, score double, merge int")

    def as_bytes(self) -> list[bytes]:
        out = [b""] * self.size
        for i, p in self.pieces.items():
            out[i] = p.encode()
        for b, i in enumerate(self.bytes):
            out[i] = bytes([b])
        return out


def words_of_text(text: str | None) -> list[bytes]:
    """The words of a text, each without its first mark, as UTF-8."""
    if not text:
        return []
    if MARK in text or "  " in text or text[0] == " ":
        return [w[1:].encode("utf-8", "surrogatepass") for w in _RUN.findall(MARK + text.replace(" ", MARK))]
    return text.encode("utf-8", "surrogatepass").split(b" ")


class _Ranks(dict):
    def __missing__(self, word):
        self[word] = i = len(self)
        return i


class _Block:
    """Collects texts; question() gives the packed words by bucket and the packed texts as places among them."""

    def __init__(self):
        self.ranks, self.size = _Ranks(), 0
        self.words: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids: list[int | None] = []

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        lists = list(map(words_of_text, texts))
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        self.words.append(np.fromiter(map(self.ranks.__getitem__, chain.from_iterable(lists)), np.int32, int(counts.sum())))
        self.counts.append(counts)
        self.ids += ids
        self.size += sum(len(t or "") for t in texts)

    def question(self, buckets: int) -> tuple[list[tuple[int, bytes]], bytes]:
        words = list(self.ranks)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
        order, asks, place = order.tolist(), [], np.empty(len(words), np.int32)
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo < hi:
                some = sorted(order[lo:hi], key=words.__getitem__)  # sorted words resemble their neighbours
                place[some] = np.arange(lo, hi, dtype=np.int32)
                asks.append((b, _pressed([words[i] for i in some])))
        ids = np.array([0 if i is None else i for i in self.ids], "<i8")
        null = np.array([i is None for i in self.ids], "<u1")
        return asks, pack(ids, null, np.concatenate(self.counts).astype("<u4"), place[np.concatenate(self.words)].astype("<u4"), level=3)


def _pressed(words: list[bytes]) -> bytes:
    """One word at least; no word has a space."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b" ".join(words))


def _unpressed(payload: bytes) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(payload).split(b" ")


ASKED = "key long, block long, ask binary, texts binary"  # one of the last two is null; key: of the bucket asked


def _questions(docs: DataFrame, buckets: int) -> DataFrame:
    """The questions and the packed texts of all blocks of docs (id, text)."""

    def rows(block: int, keys: list[int | None], asks: list[bytes | None], texts: bytes | None) -> pa.RecordBatch:
        n = len(keys)
        columns = [pa.array(keys, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(asks, pa.binary()), pa.array([texts] * n, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "block", "ask", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, block, done = TaskContext.get().partitionId() << 24, _Block(), 0

        def close() -> Iterator[pa.RecordBatch]:
            asks, texts = block.question(buckets)
            for i in range(0, len(asks), 64):
                some = asks[i : i + 64]
                yield rows(base + done, [b for b, _ in some], [p for _, p in some], None)
            yield rows(base + done, [None], [None], texts)

        for b in batches:
            at = 0
            while at < b.num_rows:
                some = b.column(1).slice(at, 2048).to_pylist()
                for lo, hi in byte_slices(some, 1 << 20):
                    block.add(b.column(0).slice(at + lo, hi - lo).to_pylist(), some[lo:hi])
                    if block.size >= BLOCK:
                        yield from close()
                        block, done = _Block(), done + 1
                at += len(some)
        if block.ids:
            yield from close()

    return docs.mapInArrow(run, ASKED)


MERGED = "key long, state binary, asked binary"


def _merge(table: pa.Table) -> pa.Table:
    """All blocks' words in one bucket -> one row: the distinct ones, and each block's places among them."""
    blocks = table.column("block").to_numpy()
    order = np.argsort(blocks, kind="stable")
    asks, ranks, asked = table.column("ask"), _Ranks(), []
    for i in order.tolist():
        words = _unpressed(asks[i].as_py())
        asked.append(np.fromiter(map(ranks.__getitem__, words), "<u4", len(words)))
    sizes = np.array([len(x) for x in asked], "<i8")
    row = (table.column("key")[0].as_py(), _pressed(list(ranks)), pack(blocks[order].astype("<i8"), sizes, np.concatenate(asked)))
    return pa.table({n: pa.array([v], k) for n, v, k in zip(("key", "state", "asked"), row, (pa.int64(), pa.binary(), pa.binary()), strict=True)})


def _is_long(word: bytes) -> bool:
    return len(word) >= MAX_WORD and len(word.decode("utf-8", "surrogatepass")) >= MAX_WORD


def _bucket_words(states: DataFrame) -> DataFrame:
    """key, rank, word (with its mark) of each bucket's distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, state in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = _unpressed(state.as_py())
                for lo in range(0, len(words), 20_000):
                    some = [(r, MARK + w.decode("utf-8", "surrogatepass")) for r, w in enumerate(words[lo : lo + 20_000], lo) if not _is_long(w)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), key, np.int64)), pa.array([r for r, _ in some], pa.int32()), pa.array([w for _, w in some], pa.string())], names=["key", "rank", "word"]
                    )

    return states.select("key", "state").mapInArrow(run, "key long, rank int, word string")


def lattice(words: DataFrame, model: PieceModel, keys: list[str]) -> DataFrame:
    """keys and `edge` of words (`keys`, which tell them apart, and `word`): the substrings that are pieces, a row each,
    a word's one after another.

    For a model of merges an edge is a long that sorts by rank and start (20 bits of the id, 7 of the size, 16 of the start, the rank above), and single characters, which need
    no merge, are left out; else a struct of start, n, id, score, where a character that is no piece has the id -1.
    """
    least = 2 if model.merges else 1
    here = words.where(F.char_length("word") >= least)
    starts = here.select(*keys, "word", F.explode(F.sequence(F.lit(0), F.char_length("word") - least)).alias("start"))
    spans = starts.select(*keys, "word", "start", F.explode(F.sequence(F.lit(least), F.least(F.lit(model.longest), F.char_length("word") - F.col("start")))).alias("n"))
    # Joined on a hash of the substring, a number, which Spark looks up faster than a string; then the strings are compared.
    text = F.expr("substring(word, start + 1, n)")
    cut = spans.select(*keys, "start", "n", F.xxhash64(text).alias("h"), "word")
    table = F.broadcast(model.table(words.sparkSession).withColumn("h", F.xxhash64("piece")))
    same = F.when(F.col("piece") == text, True).otherwise(False)
    if model.merges:
        joined = cut.join(table, "h").where(same)
        long = lambda c, bits: F.shiftleft(F.col(c).cast("long"), bits)
        edge = long("merge", 43).bitwiseOR(long("start", 27)).bitwiseOR(long("n", 20)).bitwiseOR(F.col("id").cast("long"))
    else:
        joined = cut.join(table, "h", "left").withColumn("id", F.when(same, F.col("id"))).where("id is not null or n = 1")
        edge = F.struct("start", "n", F.coalesce("id", F.lit(-1)).alias("id"), F.when(F.col("id").isNotNull(), F.col("score")).otherwise(UNKNOWN_SCORE).alias("score"))
    return joined.select(*keys, edge.alias("edge"))


def merged(word: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which edges are on their word's path by merge ranks; word: ascending numbers, from 0. Characters between them stand alone."""
    start, size = (edges >> 27) & 0xFFFF, (edges >> 20) & 0x7F
    order = np.argsort(word << 36 | (edges >> 43) << 16 | start)  # ranks have 20 bits as ids have
    first = np.flatnonzero(np.diff(word, prepend=-1))
    count = np.diff(np.append(first, len(word)))
    long = np.maximum.reduceat(start + size, first) > SHORT
    on = np.zeros(len(edges), bool)
    # Words whose cuts fit a number: the k-th edges of all of them at once, those with many edges first.
    live = np.flatnonzero(~long)
    live = live[np.argsort(-count[live], kind="stable")]
    left = np.searchsorted(-count[live], -np.arange(1, int(count[live].max(initial=0)) + 1), "right").tolist()
    cuts, one, begin = np.full(len(live), -1, np.int64), np.int64(1), first[live]
    both, window = ((one << size) | one) << np.minimum(start, SHORT), ((one << size + 1) - one) << np.minimum(start, SHORT)
    for k, n in enumerate(left):
        e = order[begin[:n] + k]
        ends, inside = both[e], cuts[:n] & window[e]
        alone = (np.bitwise_count(inside) == 3) & (inside & ends == ends)
        cuts[:n] ^= np.where(alone, inside ^ ends, 0)
    at = np.zeros(len(first), np.int64)
    at[live] = cuts
    short = ~np.repeat(long, count)
    on[short] = (at[word[short]] & window[short]) == both[short]
    # Longer words: the same with integers of any length.
    for w in np.flatnonzero(long).tolist():
        lo, hi, cut = first[w], first[w] + count[w], -1
        some = [(int(e), int(start[e]), int(size[e])) for e in order[lo:hi]]
        for _, s, n in some:
            inside = cut >> s & (2 << n) - 1
            if inside.bit_count() == 3 and inside & 1 and inside >> n:
                cut ^= (inside ^ (1 << n | 1)) << s
        for e, s, n in some:
            on[e] = cut >> s & (2 << n) - 1 == 1 << n | 1
    return on


def _folded(edges: DataFrame, keys: list[str], made: Callable, schema: str) -> DataFrame:
    """made(columns of keys, edges) -> rows, of the path's edges of many whole words; edges: keys and edge by lattice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fold(columns: list[np.ndarray], last: bool) -> tuple[pa.RecordBatch | None, list[np.ndarray]]:
            new = np.zeros(len(columns[-1]), bool)
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            upto = len(new) if last else int(np.flatnonzero(new)[-1]) if new.any() else 0
            done, rest = [c[:upto] for c in columns], [c[upto:] for c in columns]
            if not upto:
                return None, rest
            on = merged(np.cumsum(new[:upto]), done[-1])
            return made([c[on] for c in done[:-1]], done[-1][on]), rest

        held: list[list[np.ndarray]] = []
        rows = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            rows += b.num_rows
            if rows >= FOLD:
                out, rest = fold([np.concatenate(c) for c in zip(*held, strict=True)], False)
                held, rows = [rest], len(rest[-1])
                if out is not None:
                    yield out
        if rows:
            yield fold([np.concatenate(c) for c in zip(*held, strict=True)], True)[0]

    return edges.select(*keys, "edge").mapInArrow(run, schema)


def viterbi(edges):
    """The edges of the path of the largest score sum, coded as in lattice (without rank, and without characters that are no
    piece); a fold forward and a fold back."""
    edges = F.sort_array(F.transform(edges, lambda e: F.struct((e["start"] + e["n"]).alias("end"), e["start"].alias("start"), e["id"].alias("id"), e["score"].alias("score"))))
    start = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.struct(F.lit(-1).alias("id"), F.lit(0).alias("start"))).alias("last"))

    def relax(s, e):
        total = F.get(s["best"], e["start"]) + e["score"]
        here = F.struct(e["id"].alias("id"), e["start"].alias("start"))
        known = e["end"] < F.size(s["best"])
        better = total > F.get(s["best"], e["end"])
        put = lambda a, x: F.array_append(F.slice(a, F.lit(1), e["end"]), x)
        return F.when(known & ~better, s).otherwise(F.struct(put(s["best"], total).alias("best"), put(s["last"], here).alias("last")))

    def walk(s):
        empty = F.struct((F.size(s["last"]) - 1).alias("at"), F.array().cast("array<long>").alias("path"))

        def back(w, _):
            edge = F.get(s["last"], w["at"])
            code = F.shiftleft(edge["start"].cast("long"), 27).bitwiseOR(F.shiftleft((w["at"] - edge["start"]).cast("long"), 20)).bitwiseOR(edge["id"].cast("long"))
            return F.when(w["at"] == 0, w).otherwise(F.struct(edge["start"].alias("at"), F.when(edge["id"] < 0, w["path"]).otherwise(F.array_append(w["path"], code)).alias("path")))

        return F.aggregate(F.sequence(F.lit(1), F.size(s["last"])), empty, back, lambda w: w["path"])

    return F.aggregate(edges, start, relax, walk)


def word_paths(words: DataFrame, model: PieceModel, keys: list[str], short=None) -> DataFrame:
    """keys and `path` (edges as in lattice, in no order) of words; words of single characters alone are left out where the
    model merges. short isn't needed any more."""
    edges = lattice(words, model, keys)
    if not model.merges:
        return edges.groupBy(*keys).agg(F.sort_array(F.collect_list("edge")).alias("edges")).select(*keys, viterbi(F.col("edges")).alias("path"))

    def made(columns: list[np.ndarray], edges: np.ndarray) -> pa.RecordBatch:
        new = np.zeros(len(edges), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        paths = pa.ListArray.from_arrays(pa.array(np.append(first, len(edges)), pa.int32()), pa.array(edges, pa.int64()))
        return pa.RecordBatch.from_arrays([*(pa.array(c[first]) for c in columns), paths], names=[*keys, "path"])

    kinds = {f.name: f.dataType.simpleString() for f in words.schema}
    return _folded(edges, keys, made, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", path array<bigint>")


FOUND = "key long, payload binary"


def _bucket_paths(words: DataFrame, model: PieceModel) -> DataFrame:
    """The paths of words (key, rank, word): key and many of its ranks and edges, packed."""

    def packed(key: np.ndarray, rank: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)).tolist()
        rows = [pack(rank[a:e].astype("<u4"), (edges[a:e] >> 20 & 0x7FFFFF).astype("<u4"), (edges[a:e] & 0xFFFFF).astype("<u4"), level=3) for a, e in zip(cuts, cuts[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array(key[cuts[:-1]], pa.int64()), pa.array(rows, pa.binary())], names=["key", "payload"])

    if model.merges:
        return _folded(lattice(words, model, ["key", "rank"]), ["key", "rank"], lambda c, e: packed(c[0], c[1], e), FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.compute.list_value_length(b.column(2)).to_numpy()
            key, rank = (np.repeat(b.column(i).to_numpy(), n) for i in (0, 1))
            order = np.argsort(key, kind="stable")
            yield packed(key[order], rank[order], pa.compute.list_flatten(b.column(2)).to_numpy()[order])

    return word_paths(words, model, ["key", "rank"]).mapInArrow(run, FOUND)


class Speller:
    """Puts words' ids together from their characters and the edges of their paths."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.single = {p: i for i, p in model.pieces.items() if len(p) == 1}

    def ids(self, words: list[str], owner: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each word's number of them; owner: the word of each edge."""
        text = "".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, at = np.unique(chars, return_inverse=True)
        known = np.array([self.single.get(chr(c), -1) for c in kinds.tolist()], np.int64)
        spelled = [[self.model.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] if i < 0 else [i] for c, i in zip(kinds.tolist(), known.tolist(), strict=True)]
        width = np.fromiter(map(len, spelled), np.int64, len(spelled))
        first = np.cumsum(width) - width
        flat = np.array([i for x in spelled for i in x], np.int64)
        # Every character's ids: where they begin in a table, and how many; edges take their characters' place.
        begin, count = first[at], width[at]
        where = (np.cumsum(sizes) - sizes)[owner] + (edges >> 27 & 0xFFFF)
        n = edges >> 20 & 0x7F
        covered = np.repeat(where - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        count[covered] = 0
        count[where] = 1
        begin[where] = len(flat) + np.arange(len(where))
        flat = np.concatenate([flat, edges & 0xFFFFF])
        ends = np.cumsum(count)
        out = flat[np.repeat(begin - (ends - count), count) + np.arange(int(ends[-1]) if len(ends) else 0)].astype(np.int32)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return out, np.diff(upto)


ENCODED = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"


def encode(docs: DataFrame, model_path: str, *, id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: the number of pieces, the CRC-32 of its ids as little-endian 32-bit numbers, and whether they decode
    to the text; with with_ids also the ids."""
    spark, model = docs.sparkSession, PieceModel(model_path)
    buckets = shuffle_parts(spark)
    rows = docs.select(F.col(id).cast("long"), F.col(text).cast("string"))
    asked = _bucketed(_questions(rows, buckets), buckets, "block")
    merged = _bucketed(asked.where("ask is not null").select("key", "block", "ask").groupBy("key").applyInArrow(_merge, MERGED), buckets)
    released(spark)
    found = _bucketed(_bucket_paths(_bucket_words(merged), model), buckets)
    spelling, speller = model.as_bytes(), Speller(model)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        key, words = left.column("key")[0].as_py(), _unpressed(left.column("state")[0].as_py())
        parts = [unpack(p.as_py()) for p in right.column("payload")]
        owner, where, piece = (np.concatenate([p[i] for p in parts] or [np.zeros(0, "<u4")]).astype(np.int64) for i in range(3))
        order = np.argsort(owner, kind="stable")
        owner, edges, library = owner[order], (where << 20 | piece)[order], None
        flats, sizes, right_ = [], [], np.ones(len(words), bool)
        for lo in range(0, len(words), SPELL):
            some = words[lo : lo + SPELL]
            a, e = np.searchsorted(owner, [lo, lo + len(some)])
            long = {i for i, w in enumerate(some) if _is_long(w)}
            flat, lengths = speller.ids(["" if i in long else MARK + w.decode("utf-8", "surrogatepass") for i, w in enumerate(some)], owner[a:e] - lo, edges[a:e])
            if long:
                import sentencepiece

                library = library or sentencepiece.SentencePieceProcessor(model_file=model_path)
                each = np.split(flat, np.cumsum(lengths)[:-1])
                for i in long:
                    each[i] = np.array(library.encode(some[i].decode("utf-8", "surrogatepass").replace(MARK, " ")), np.int32)
                flat, lengths = np.concatenate(each), np.array([len(x) for x in each], np.int64)
            ids, at = flat.tolist(), 0
            for i, (w, k) in enumerate(zip(some, lengths.tolist(), strict=True)):
                right_[lo + i] = b"".join([spelling[x] for x in ids[at : at + k]]) == mark + w
                at += k
            flats.append(flat)
            sizes.append(lengths)
        flat, lengths = np.concatenate(flats).astype("<u2" if model.size <= 1 << 16 else "<u4"), np.concatenate(sizes)
        starts = np.cumsum(lengths) - lengths
        blocks, counts, back = unpack(left.column("asked")[0].as_py())
        out = []
        for block, mine in zip(blocks.tolist(), np.split(back, np.cumsum(counts)[:-1]), strict=True):
            out.append(("answer", key, block, pack(lengths[mine].astype("<u4"), right_[mine].astype("<u1"), _taken(flat, starts[mine], lengths[mine]))))
        return pa.Table.from_batches([_row(out)])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_pieces": [], "ids_crc32": [], "round_trip": [], "ids": []}
        if left.num_rows:
            numbers, null, counts, places = unpack(left.column("texts")[0].as_py())
            keys, payloads = right.column("key").to_numpy(), right.column("payload")
            parts = [unpack(payloads[i].as_py()) for i in np.argsort(keys).tolist()]
            lengths, good, flat = (np.concatenate([p[i] for p in parts] or [np.zeros(0, "<u4")]) for i in range(3))
            lengths = lengths.astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for m in np.split(places, np.cumsum(counts.astype(np.int64))[:-1]):
                x = _taken(flat, starts[m], lengths[m])
                out["n_pieces"].append(len(x))
                out["ids_crc32"].append(zlib.crc32(x.astype("<u4").tobytes()))
                out["round_trip"].append(bool(good[m].all()))
                if with_ids:
                    out["ids"].append(x.tolist())
            out["doc_id"] = pa.array(numbers, pa.int64(), mask=null.astype(bool))
        kinds = {"doc_id": pa.int64(), "n_pieces": pa.int64(), "ids_crc32": pa.int64(), "round_trip": pa.bool_()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
        return pa.table({n: pa.array(out[n], k) if isinstance(out[n], list) else out[n] for n, k in kinds.items()})

    mark = MARK.encode()
    answers = merged.groupBy("key").cogroup(found.groupBy("key")).applyInArrow(answer, ROW)
    texts = asked.where("texts is not null").select("block", "texts")
    return texts.groupBy("block").cogroup(answers.select("key", "block", "payload").groupBy("block")).applyInArrow(finish, ENCODED + (", ids array<int>" if with_ids else ""))


def _taken(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The slices of flat, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


def decode(encoded: DataFrame, model_path: str, *, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """id and text of arrays of ids: positions are exploded, joined to the spellings and put together again by id.

    Ids must be unique in `id`. Unknown ids and control pieces have no spelling; broken UTF-8 gives U+FFFD.
    """
    model = PieceModel(model_path)
    spark = encoded.sparkSession
    spelled = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(model.as_bytes())], "piece_id int, spelling binary")
    places = encoded.select(F.col(id), F.posexplode(ids).alias("at", "piece_id")).join(F.broadcast(spelled), "piece_id", "left")
    parts = places.groupBy(id).agg(F.sort_array(F.collect_list(F.struct("at", F.hex(F.coalesce("spelling", F.lit(b""))).alias("hex")))).alias("parts"))
    marked = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    text = F.regexp_replace(F.replace(F.decode(marked, "UTF-8"), F.lit(MARK), F.lit(" ")), "^ ", "")
    return encoded.select(id).join(parts.select(id, text.alias("text")), id, "left").select(id, F.coalesce("text", F.lit("")).alias("text"))
