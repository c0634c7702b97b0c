"""Language-model scores by a hierarchical Pitman-Yor process.

Tokens are lower-cased words and one end a text. A token is drawn in the restaurant of its context, the word before it
(at a text's start, the end token); that restaurant's parent is the restaurant of all tokens, whose base is uniform
over the V training tokens and one unseen. There is one restaurant for each distinct word, so contexts and dishes both
grow with the corpus. A context is known by 48 bits of its word's hash, a token by 80.

Seating. For each dish in each restaurant only customers c and tables t are kept. A sweep reseats every dish's
customers in turn, each at a new table with probability a / (a + k - d t), where k are already seated at t tables and
a = (strength + discount * tables of the restaurant) * probability in the parent (blocked Gibbs: a dish's customers are
removed together and seated again given all other dishes). New tables are customers of the parent. A restaurant's
total number of tables is summed over the corpus after each sweep and held during the next. The predictive
probabilities of the sweeps after burn-in are averaged. Discounts are estimated from the counts of counts.

Spread. Texts are read once, in blocks. A block asks, for each of its distinct (context, token) pairs, in the bucket
of the token's hash; a bucket merges the counts of all blocks, samples its own dishes, and answers every
block's pairs in the order asked. All training text is counted; nothing is pruned. A token is at most once in a block's
question, so frequent words make no hot bucket. A restaurant's dishes lie in many buckets: the owner of the range that
the context's hash is in sums its tables, and after each sweep every bucket sends the sums of its contexts there and gets
the totals back. There are as many owners as the contexts need: at most as many as let a message hold LEAST contexts on
the average, but enough that none gathers more than some MOST. So messages grow with the contexts, not with the square of
the buckets, up to MOST / LEAST buckets. Neither the driver nor a broadcast holds anything by context.

Defined cases: null and empty texts are one end token; without training texts N and V are 0 and every token has
probability 1; repeated rows count and are scored each; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, shared_dir, shuffle_parts, small_batches, staged

BLOCK = 6 << 20
BATCH = 2 << 20  # bytes of rows that go to Python at once, where they are computed at once
END = b""  # no word is empty
BURN_IN, SAMPLES = 5, 5
STRENGTH = (2.0, 10.0)  # of the contexts, the root
STEPS = 24  # customers seated one by one before many are in a round
LEAST, MOST = 1 << 12, 1 << 21  # contexts in a message to an owner, on the average; those that one owner gathers


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """The arrays, compressed; all numbers' first bytes, then all second ones, and so on, as these resemble each other."""
    import zstandard

    parts = []
    for a in arrays:
        planes, values = np.empty((a.itemsize, len(a)), np.uint8), np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize)
        for k in range(a.itemsize):  # much faster than a transposed copy
            planes[k] = values[:, k]
        parts += [struct.pack("<2sxxxxxxq", a.dtype.str[1:].encode(), len(a)), planes.tobytes()]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(raw):
        kind, n = struct.unpack_from("<2sxxxxxxq", raw, at)
        dtype = np.dtype("<" + kind.decode())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at + 16).reshape(dtype.itemsize, n)
        values = np.empty((n, dtype.itemsize), np.uint8)
        for k in range(dtype.itemsize):
            values[:, k] = planes[k]
        a = values.view(dtype).reshape(n)
        out.append(a)
        at += 16 + a.nbytes
    return out


def _halves(contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return contexts.astype("<u4"), (contexts >> np.uint64(32)).astype("<u2")


def _bytes_list(a: pa.Array) -> list[bytes]:
    """to_pylist of a binary array that is no slice and has no nulls, some four times as fast."""
    if not len(a):
        return []
    data = bytes(a.buffers()[2] or b"")
    return [data[i:j] for i, j in itertools.pairwise(np.frombuffer(a.buffers()[1], np.int32, len(a) + 1).tolist())]


class Block:
    """Collects texts; question() gives the packed pairs by bucket and the packed texts in terms of them."""

    def __init__(self):
        self.size = 0
        self.words: list[pa.Array] = []
        self.ids: list[pa.Array] = []
        self.counts: list[np.ndarray] = []
        self.learn: list[np.ndarray] = []

    def add(self, ids: pa.Array | list[int | None], texts: pa.Array | list[str | None], learn: pa.Array | list[bool]) -> None:
        import pyarrow.compute as pc

        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        # As words_of, but for empty strings at a text's ends: these kernels act on the same ASCII characters only.
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        self.words.append(lists.flatten().cast(pa.binary()))
        self.counts.append(np.asarray(lists.value_lengths()))
        self.ids.append(pa.array(ids.to_pylist() if isinstance(ids, pa.Array) else ids, pa.int64()))  # a slice would hold its batch
        self.learn.append(np.array(learn, bool))
        self.size += pc.sum(pc.binary_length(texts)).as_py() or 0

    def tokens(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct tokens, END last; the texts' tokens by their places there; and how many each text has. Called once."""
        coded = pa.chunked_array(self.words, pa.binary()).dictionary_encode()
        self.words.clear()
        words = _bytes_list(coded.chunk(0).dictionary)
        codes = np.concatenate([np.asarray(c.indices) for c in coded.chunks])
        counts = np.concatenate(self.counts).astype(np.int64)
        if END in words:  # empty strings, which are no words: the last word takes their place among the distinct ones
            empty = words.index(END)
            full = codes != empty
            counts = np.diff(np.append(0, np.cumsum(full))[np.append(0, np.cumsum(counts))])
            codes = codes[full]
            words[empty] = words[-1]
            codes[codes == len(words) - 1] = empty
            words.pop()
        counts += 1
        tokens, is_word = np.full(len(codes) + len(counts), len(words), np.int32), np.ones(len(codes) + len(counts), bool)
        is_word[np.cumsum(counts) - 1] = False
        tokens[is_word] = codes
        return [*words, END], tokens, counts

    def question(self, buckets: int) -> tuple[list[tuple[int, bytes]], bytes]:
        words, tokens, counts = self.tokens()
        learn = np.concatenate(self.learn)
        digests = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in words), "<u8").reshape(-1, 2)
        digests = np.stack([digests[:, 0], digests[:, 1] & np.uint64(0xFFFF)], 1)
        order = np.lexsort((digests[:, 1], digests[:, 0], digests[:, 0] % np.uint64(buckets)))
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[np.cumsum(counts) - counts] = len(words) - 1  # a text's start
        keys = rank[tokens] << 32
        keys |= rank[before]
        del tokens, before, words
        pairs, at = np.unique(keys, return_inverse=True)
        del keys
        at = at.astype("<u4")
        seen = np.bincount(at[np.repeat(learn, counts)], minlength=len(pairs))
        digests = digests[order]
        bucket = (digests[:, 0] % np.uint64(buckets)).astype(np.int64)
        starts = np.searchsorted(bucket, np.arange(buckets + 1))
        pair_at = np.searchsorted(pairs >> 32, starts)
        contexts = digests[pairs & 0xFFFFFFFF, 0] >> np.uint64(16)
        out = []
        for b in range(buckets):
            lo, hi, p, q = starts[b], starts[b + 1], pair_at[b], pair_at[b + 1]
            if lo < hi:
                per_word = np.bincount((pairs[p:q] >> 32) - lo, minlength=hi - lo)
                # 80 bits of a token's hash and 48 of a context's: at 10 ** 11 of each, under one in a thousand meets another.
                out.append((b, pack(digests[lo:hi, 0], digests[lo:hi, 1].astype("<u2"), per_word.astype("<u4"), *_halves(contexts[p:q]), seen[p:q].astype("<u4"))))
        ids = pa.chunked_array(self.ids).combine_chunks()
        null = np.asarray(ids.is_null())
        return out, pack(np.asarray(ids.fill_null(0)).astype("<i8"), null.astype("<u1"), counts.astype("<u4"), at)


ROW = "kind string, key long, block long, payload binary"


def _row(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary())], names=["kind", "key", "block", "payload"])


def _questions(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows `ask` (key: bucket) and `text` (key: above the buckets, its own) of all blocks of docs (doc_id, text, learn)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        base, block, done = TaskContext.get().partitionId() << 24, Block(), 0

        def close() -> Iterator[pa.RecordBatch]:
            asks, texts = block.question(buckets)
            for i in range(0, len(asks), 64):
                yield _row([("ask", b, base + done, p) for b, p in asks[i : i + 64]])
            yield _row([("text", buckets + base + done, base + done, texts)])
            pa.default_memory_pool().release_unused()  # the process stays for later stages

        for b in batches:
            ends, lo = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)), dtype=np.int64), 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
                block.add(*(c.slice(lo, hi - lo) for c in b.columns))
                lo = hi
                if block.size >= BLOCK:
                    yield from close()
                    block, done = Block(), done + 1
        if block.ids:
            yield from close()

    return docs.mapInArrow(run, ROW)


def _merge(table: pa.Table) -> pa.Table:
    """All blocks' questions to one bucket -> one state row: distinct pairs with their counts, and each block's pairs.

    A packed text, which has a key of its own, passes through.
    """
    is_text = np.array([k == "text" for k in table.column("kind").to_pylist()], bool)
    texts, table = table.filter(pa.array(is_text)), table.filter(pa.array(~is_text))
    rows = [("text", k, b, None, p, None) for k, b, p in zip(*(texts.column(c).to_pylist() for c in ("key", "block", "payload")), strict=True)]
    if table.num_rows:
        blocks = table.column("block").to_numpy()
        order = np.argsort(blocks, kind="stable")
        payloads = table.column("payload")
        asked = [unpack(payloads[int(i)].as_py()) for i in order]
        high, low = np.concatenate([a[0] for a in asked]), np.concatenate([a[1] for a in asked])
        by = np.lexsort((low, high))
        new = np.ones(len(by), bool)
        new[1:] = (high[by][1:] != high[by][:-1]) | (low[by][1:] != low[by][:-1])
        word = np.empty(len(by), np.int64)
        word[by] = np.cumsum(new) - 1
        per_word = np.concatenate([a[2] for a in asked])
        every = np.concatenate([a[3].astype(np.uint64) | a[4].astype(np.uint64) << np.uint64(32) for a in asked])
        contexts, context = np.unique(every, return_inverse=True)
        keys = np.repeat(word, per_word) << 32 | context
        pairs, back = np.unique(keys, return_inverse=True)
        c = np.bincount(back, np.concatenate([a[5] for a in asked]), minlength=len(pairs)).astype("<u4")
        state = pack((pairs >> 32).astype("<u4"), (pairs & 0xFFFFFFFF).astype("<u4"), c, *_halves(contexts))
        sizes = np.array([len(a[3]) for a in asked], "<i8")
        rows.append(("state", table.column("key")[0].as_py(), None, len(contexts), state, pack(blocks[order].astype("<i8"), sizes, back.astype("<u4"))))
    columns = list(zip(*rows, strict=True))
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("kind", "key", "block", "contexts", "state", "asked"), columns, kinds, strict=True)})


MERGED = "kind string, key long, block long, contexts long, state binary, asked binary"


def owner_count(contexts: int, buckets: int) -> int:
    """How many owners `contexts` have, counted in each bucket that has them."""
    return max(1, min(buckets, contexts // (buckets * LEAST)), -(-contexts // MOST))


def reseat(customers: np.ndarray, discount: float, new: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers are seated one after another; new is a dish's weight for a new table."""
    tables = np.minimum(customers, 1)
    live = np.flatnonzero(customers > 1)
    for k in range(1, STEPS):
        if not len(live):
            return tables
        t, a = tables[live], new[live]
        tables[live] = t + (rng.random(len(live)) * (a + k - discount * t) < a)
        live = live[customers[live] > k + 1]
    # For the many customers left: as the chance falls with each customer, those at new tables are among candidates drawn
    # by the chance at a round's start, each kept by the fall since. A round has about weight / 2 candidates of each dish.
    seated = np.full(len(live), STEPS)
    while len(live):
        a, left = new[live], customers[live] - seated
        start = a + seated - discount * tables[live]
        n = np.clip(np.ceil(a / 2), 1, left).astype(np.int64)
        ends = np.cumsum(n)
        dish = np.repeat(np.arange(len(live)), n)
        with np.errstate(divide="ignore"):
            gaps = np.floor(np.log1p(-rng.random(len(dish))) / np.log1p(-a / start)[dish])
        place = np.cumsum(np.minimum(gaps, left[dish]) + 1)
        place -= np.repeat(np.append(0.0, place[ends[:-1] - 1]), n)
        inside = place <= left[dish]
        fall = place - 1 + start[dish] * (1 - 1 / (1 - rng.random(len(dish))))
        # Kept are those whose fall is below what the new tables before them, again kept ones, give back.
        kept = inside
        while True:
            before = np.cumsum(kept) - kept
            before -= np.repeat(before[ends - n], n)
            again = inside & (fall < discount * before)
            if np.array_equal(again, kept):
                break
            kept = again
        tables[live] += np.add.reduceat(kept, ends - n, dtype=np.int64)
        seated = seated + np.minimum(place[ends - 1], left).astype(np.int64)
        on = seated < customers[live]
        live, seated = live[on], seated[on]
    return tables


class Dishes:
    """One bucket's dishes in the contexts and in the root, and sweeps over them.

    contexts are the hashes of the bucket's contexts, ascending; every total by context is in their order.
    """

    def __init__(self, state: bytes, key: int, seats: bytes | None = None):
        word, context, c, low, high = unpack(state)
        self.contexts = low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)
        self.word, self.context, self.c = word.astype(np.int64), context.astype(np.int64), c.astype(np.int64)
        self.n_words = int(self.word[-1]) + 1 if len(self.word) else 0
        self.key = key
        self.t1 = np.minimum(self.c, 1)  # least tables, for the start
        if seats is not None:
            self.t1 = self.t1.copy()
            self.t1[self.c > 1] = unpack(seats)[0]
        self.c0 = np.bincount(self.word, self.t1, minlength=self.n_words).astype(np.int64)
        self.t0 = np.minimum(self.c0, 1) if seats is None else unpack(seats)[1].astype(np.int64)

    def seats(self) -> bytes:
        """What a later pass needs besides the state: dishes of one customer have one table."""
        return pack(self.t1[self.c > 1].astype("<u4"), self.t0.astype("<u4"))

    def by_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, values, minlength=len(self.contexts)).astype(np.int64)

    def root(self, model: Model) -> np.ndarray:
        return model.draw(1, self.c0, self.t0, model.root_customers, model.root_tables, 1.0 / (model.types + 1))

    def probabilities(self, model: Model, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return model.draw(0, self.c, self.t1, customers[self.context], tables[self.context], self.root(model)[self.word])

    def sweep(self, model: Model, tables: np.ndarray, number: int) -> None:
        rng = np.random.default_rng([self.key, number])
        self.t1 = reseat(self.c, model.discount[0], model.weight(0, tables[self.context]) * self.root(model)[self.word], rng)
        self.c0 = np.bincount(self.word, self.t1, minlength=self.n_words).astype(np.int64)
        self.t0 = reseat(self.c0, model.discount[1], np.full(self.n_words, model.weight(1, model.root_tables)) / (model.types + 1), rng)

    def rows(self, number: int, owners: int, *, first: bool = False) -> pa.RecordBatch:
        """Seats, tables by context to the contexts' owners, and sums of the root; first also the contexts' customers."""
        by_word = np.bincount(self.word, self.c, minlength=self.n_words)
        sums = [self.c.sum(), (by_word > 0).sum(), (self.c == 1).sum(), (self.c == 2).sum(), (self.c0 == 1).sum(), (self.c0 == 2).sum(), self.c0.sum(), self.t0.sum()]
        out = [("seats", self.key, number, self.seats()), ("root", self.key, number, pack(np.array(sums, "<i8")))]
        sent = [("tables", self.by_context(self.t1).astype("<u4"))]
        if first:
            sent += [("customers", self.by_context(self.c).astype("<u4"))]
        for kind, values in sent:
            out += [(kind, owner, self.key, pack(values[lo:hi])) for owner, lo, hi in self.by_owner(owners)]
        return _row(out)

    def by_owner(self, owners: int) -> list[tuple[int, int, int]]:
        """(owner, first, last + 1) of the contexts of each owner; owners have equal ranges of the hashes."""
        cuts = np.searchsorted(self.contexts, np.array([-(-(i << 48) // owners) for i in range(owners + 1)], np.uint64)).tolist()
        return [(i, lo, hi) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]

    def asking(self, owners: int) -> pa.RecordBatch:
        """The contexts themselves, to their owners."""
        return _row([("contexts", owner, self.key, pack(*_halves(self.contexts[lo:hi]))) for owner, lo, hi in self.by_owner(owners)])


class Model:
    """What is one number for the corpus."""

    def __init__(self, tokens: int, types: int, discount: tuple[float, float], root_customers: int, root_tables: int):
        self.tokens, self.types, self.discount, self.root_customers, self.root_tables = tokens, types, discount, root_customers, root_tables

    def weight(self, level: int, tables):
        return STRENGTH[level] + self.discount[level] * tables

    def draw(self, level: int, c, t, customers, tables, parent):
        """The predictive probability: existing tables, and a new table times the parent's probability."""
        return (np.maximum(c - self.discount[level] * t, 0) + self.weight(level, tables) * parent) / (STRENGTH[level] + customers)


def _bucketed(df: DataFrame, n: int, by: str = "key") -> DataFrame:
    """df written once as a table in n buckets by key (or block), which later groupings by it don't shuffle."""
    spark, name = df.sparkSession, f"lm_{uuid.uuid4().hex}"
    df.write.bucketBy(n, by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved now; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def _each(states: DataFrame, made) -> DataFrame:
    """made(Dishes) -> rows, of every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, state in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield made(Dishes(state.as_py(), key))

    return states.select("key", "state").mapInArrow(run, ROW)


def _ordered(table: pa.Table, kind: str) -> list[tuple[int, bytes]]:
    """(block, payload) of a kind's rows, by block."""
    kinds, blocks, payloads = table.column("kind").to_pylist(), table.column("block").to_pylist(), table.column("payload")
    return sorted((blocks[i], payloads[i].as_py()) for i, k in enumerate(kinds) if k == kind)


def _own(table: pa.Table) -> pa.Table:
    """The contexts that all buckets sent to their owner -> one row: each sender's places among the distinct ones."""
    sent = [(b, low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)) for b, (low, high) in ((b, unpack(p)) for b, p in _ordered(table, "contexts"))]
    places = np.unique(np.concatenate([x for _, x in sent]), return_inverse=True)[1]
    payload = pack(np.array([b for b, _ in sent], "<i8"), np.array([len(x) for _, x in sent], "<i8"), places.astype("<u4"))
    return pa.table({"key": pa.array([table.column("key")[0].as_py()], pa.int64()), "places": pa.array([payload], pa.binary())})


def _totals(owners: DataFrame, sent: DataFrame, kind: str) -> DataFrame:
    """Sums over all senders by context, to each sender in its order: rows of the kind, block: owner."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        senders, sizes, places = unpack(left.column("places")[0].as_py())
        values = np.concatenate([unpack(p)[0] for _, p in _ordered(right, kind)])
        total = np.bincount(places, values)
        total = total.astype("<u4" if total.max(initial=0) < 1 << 32 else "<i8")[places]
        ends, owner = np.cumsum(sizes), left.column("key")[0].as_py()
        return pa.Table.from_batches([_row([(kind, int(s), owner, pack(total[e - n : e])) for s, n, e in zip(senders, sizes, ends, strict=True)])])

    return owners.groupBy("key").cogroup(sent.where(F.col("kind") == kind).groupBy("key")).applyInArrow(run, ROW)


def _joined(table: pa.Table, kind: str) -> np.ndarray:
    """A bucket's totals, the owners' parts one after another."""
    return np.concatenate([unpack(p)[0] for _, p in _ordered(table, kind)]).astype(np.int64)


def _swept(states: DataFrame, rows: DataFrame, model: Model, number: int, owners: int) -> DataFrame:
    """One sweep of every bucket; rows: its seats and the tables by context."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        dishes = Dishes(left.column("state")[0].as_py(), left.column("key")[0].as_py(), _ordered(right, "seats")[0][1])
        dishes.sweep(model, _joined(right, "tables"), number)
        return pa.Table.from_batches([dishes.rows(number, owners)])

    return states.select("key", "state").groupBy("key").cogroup(rows.groupBy("key")).applyInArrow(run, ROW)


def _root_sums(rows: DataFrame) -> list[int]:
    """tokens, types, pairs of one and of two, dishes of the root of one and of two, its customers and tables; a row a bucket is read."""
    sums = [unpack(bytes(r.payload))[0] for r in rows.where("kind = 'root'").select("payload").collect()]
    return [int(x) for x in np.sum(sums, 0)] if sums else [0] * 8


def _discount(once: int, twice: int) -> float:
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _answers(states: DataFrame, rows: DataFrame, models: dict[int, Model]) -> DataFrame:
    """For every block and bucket: log10 of the probability averaged over the kept sweeps and the token's count, by the block's pairs.

    rows: customers by context, and of each kept sweep (its number is in the kind) the seats and the tables by context.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, state, customers, mean = left.column("key")[0].as_py(), left.column("state")[0].as_py(), _joined(right, "customers"), 0.0
        for i, model in models.items():
            dishes = Dishes(state, key, _ordered(right, f"seats{i}")[0][1])
            mean = mean + dishes.probabilities(model, customers, _joined(right, f"tables{i}"))
        with np.errstate(divide="ignore"):
            logs = np.log10(mean / len(models)).astype("<f4")
        counts = np.bincount(dishes.word, dishes.c, minlength=dishes.n_words)[dishes.word].astype("<u4")
        blocks, sizes, back = unpack(left.column("asked")[0].as_py())
        out, ends = [], np.cumsum(sizes)
        for block, hi, size in zip(blocks.tolist(), ends.tolist(), sizes.tolist(), strict=True):
            mine = back[hi - size : hi]
            out.append(("answer", key, block, pack(logs[mine], counts[mine])))
        return pa.Table.from_batches([_row(out)])

    return states.groupBy("key").cogroup(rows.groupBy("key")).applyInArrow(run, ROW)


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, train_types long, base_score double, score double"


def score_texts(docs: DataFrame, learn: Column, *, id: str = "doc_id", text: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Scores of all texts under the model of those that meet `learn`; also the add-one unigram score of the same counts.

    score and base_score are log10 probabilities of the whole text; perplexity is 10 ** (-score / n_tokens).
    """
    spark = docs.sparkSession
    buckets = shuffle_parts(spark)
    rows = docs.select(F.col(id).cast("long"), F.col(text).cast("string"), F.coalesce(learn, F.lit(False)))
    # One exchange carries the questions to their buckets and each packed text to a group of its own; both are written there.
    with small_batches(spark, BATCH):
        merged = _bucketed(_questions(rows, buckets).groupBy("key").applyInArrow(_merge, MERGED), buckets)
    released(spark)
    states = merged.where("kind = 'state'").select("key", "state", "asked")
    n_owners = owner_count(merged.agg(F.sum("contexts")).first()[0] or 0, buckets)
    rows = staged(_each(states, lambda dishes: dishes.rows(0, n_owners, first=True)), "lm-start", ["kind"]).select("kind", "key", "block", "payload")
    tokens, types, p1, p2, u1, u2, *root = _root_sums(rows)
    discount = (_discount(p1, p2), _discount(u1, u2))
    owners = _bucketed(_each(states, lambda dishes: dishes.asking(n_owners)).groupBy("key").applyInArrow(_own, "key long, places binary"), buckets)
    released(spark)
    seen, models = _totals(owners, rows, "customers"), {}
    for i in range(1, burn_in + samples + 1):
        given = rows.where("kind = 'seats'").unionByName(_totals(owners, rows, "tables"))
        rows = staged(_swept(states, given, Model(tokens, types, discount, *root), i, n_owners), "lm-sweep", ["kind"]).select("kind", "key", "block", "payload")
        root = _root_sums(rows)[-2:]
        if i > burn_in:
            models[i] = Model(tokens, types, discount, *root)
            kept = rows.where("kind = 'seats'").unionByName(_totals(owners, rows, "tables"))
            seen = seen.unionByName(kept.withColumn("kind", F.concat("kind", F.lit(str(i)))))
    total = np.log10(tokens + types + 1.0)

    def finish(table: pa.Table) -> pa.Table:
        kinds, keys, payloads = table.column("kind").to_pylist(), table.column("key").to_pylist(), table.column("payload")
        answers = [unpack(payloads[i].as_py()) for _, i in sorted((k, i) for i, (kind, k) in enumerate(zip(kinds, keys, strict=True)) if kind == "answer")]
        logs, counts = (np.concatenate([a[j] for a in answers]).astype(float) for j in (0, 1))
        ids, null, sizes, at = unpack(payloads[kinds.index("text")].as_py())
        sizes = sizes.astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        known = np.add.reduceat((counts[at] > 0).astype(np.int64), starts)
        base = np.add.reduceat(np.log10(counts + 1.0)[at], starts) - sizes * total
        score = np.add.reduceat(logs[at], starts)
        n = len(ids)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)),
                "n_tokens": pa.array(sizes),
                "n_known": pa.array(known),
                "train_tokens": pa.array(np.full(n, tokens, np.int64)),
                "train_types": pa.array(np.full(n, types, np.int64)),
                "base_score": pa.array(base),
                "score": pa.array(score),
            }
        )

    texts = merged.where("kind = 'text'").select("kind", "key", "block", F.col("state").alias("payload"))
    return texts.unionByName(_answers(states, seen, models)).groupBy("block").applyInArrow(finish, SCORES)
