"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles are grouped in bands of nearly equal size. Two sets of a band that are similar enough differ in at
most k elements (the band's Hamming bound). The domain of elements is cut by a hash into n1 groups of n2 partitions;
by the pigeonhole some group has at most k2 = ceil((k + 1) / n1) - 1 differences, so in that group some subset of
n2 - k2 partitions has none. Each set's signatures are the hashes of its elements in every such subset of every group:
similar sets share a signature, always. A set signs for its own band and the next, which covers pairs in adjacent bands.

Steps:
1. Equal sets form classes; only a class's first document takes part further.
2. Signatures meet in buckets; a bucket returns its groups of sets that share one (each distinct group once). Each set
   has a sketch of parity bits, two to four times as many as it has elements; two sets differ in at least as many elements
   as their sketches in bits, so groups are split where the sketches prove that no similar pair is lost.
3. Every set is verified against one partner, the member of its groups that shares most; links make components.
4. Groups that still span components are verified in blocks: their sets are dealt to tasks for pairs of chunks, where
   all pairs of different components are compared by a matrix product. Candidates are never written as pairs.

All similarities are computed on the whole sets. Texts are packed once in blocks and not shuffled; sets travel to the
tasks that compare them.

Defined cases: null texts and texts without words have no shingles and are linked with nothing; texts with fewer words
than a shingle have one, the whole sequence; repeated rows belong to one component; a null id takes part, and is the
component's id only if all its ids are null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import LAST_ID, QUESTION, Texts, answered, in_order, question_rows, text_blocks
from .common import shuffle_parts, staged
from .pitmanyor import pack

SHINGLE, SIMILAR = 4, (85, 100)
CHUNK = 400  # sets a chunk in step 4
BLOCK = 4 << 20
BUCKETS = 4  # a shuffle partition
SKETCHES = 512, 1 << 16  # least and most bits of a sketch
FAN = 256  # sets a task verifies against one partner
_MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX2
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def word_hashes(texts: Texts, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each lower-cased word of texts lo..hi, and each text's number of words."""
    at, end = int(texts.starts[lo]), int(texts.ends[hi - 1])
    b = texts.bytes[at:end]
    counts = np.zeros(hi - lo, np.int64)
    if not len(b):
        return np.zeros(0, np.uint64), counts
    letter = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.zeros(len(b), bool)  # a text's first byte starts a word of its own
    edge[(texts.starts[lo:hi] - at)[texts.lengths[lo:hi] > 0]] = True
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    low = b + np.where((b >= 65) & (b <= 90), np.uint8(32), np.uint8(0))
    place = np.arange(len(b), dtype=np.int64) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place = np.where(letter, place, 0)
    power = np.cumprod(np.full(int(place.max()) + 1, _MIX1))
    h = np.add.reduceat(np.where(letter, (low + np.uint64(1)) * power[place], np.uint64(0)), starts)
    bounds = np.searchsorted(starts, np.append(texts.starts[lo:hi], texts.ends[hi - 1]) - at)
    return mix(h), np.diff(bounds)


def shingle_sets(texts: Texts, size: int = SHINGLE) -> Iterator[tuple[int, np.ndarray]]:
    """(text's number, its sorted distinct shingle hashes) for every text."""
    multipliers = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(size)]
    for lo, hi in texts.groups():
        h, counts = word_hashes(texts, lo, hi)
        end = 0
        for i, n in zip(range(lo, hi), counts.tolist(), strict=True):
            w, end = h[end : end + n], end + n
            if n == 0:
                yield i, w
                continue
            m = max(1, n - size + 1)
            s = np.full(m, np.uint64(min(n, size)))
            for k in range(min(n, size)):
                s += w[k : k + m] * multipliers[k]
            yield i, np.unique(mix(s))


class Bands:
    """Size bands and their PartEnum parameters for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.lows = [1]

    def band(self, size: int) -> int:
        while self.lows[-1] <= size:
            low = self.lows[-1]
            self.lows.append(max(low + 1, low * self.den // self.num + 1))
        return int(np.searchsorted(self.lows, size, "right")) - 1

    @lru_cache(None)  # noqa: B019
    def parameters(self, band: int) -> tuple[int, int, int]:
        """n1, n2, k2 of a band. Small bounds enumerate in one group; large ones in groups of three partitions less one."""
        while len(self.lows) <= band + 1:
            self.band(self.lows[-1])
        largest = self.lows[band + 1] - 1
        k = (self.den - self.num) * 2 * largest // (self.den + self.num)
        if k == 0:
            return 1, 1, 0
        if k <= 4:
            return 1, k + 3, k
        n1 = (k + 2) // 2  # ceil((k + 1) / 2) groups leave one difference in some group
        return n1, 3, 1

    def signatures(self, elements: np.ndarray) -> np.ndarray:
        """All signatures of one non-empty set."""
        own = self.band(len(elements))
        out = []
        for band in (own, own + 1):
            n1, n2, k2 = self.parameters(band)
            part = ((elements ^ np.uint64(band * 0x51ED27)) * _MIX1 >> np.uint64(33)).astype(np.int64) % (n1 * n2)
            order = np.argsort(part, kind="stable")
            sums = np.zeros(n1 * n2 + 1, np.uint64)
            values = mix(elements[order] + np.uint64(band + 1))
            total = np.concatenate([[np.uint64(0)], np.cumsum(values)])
            bounds = np.searchsorted(part[order], np.arange(n1 * n2 + 1))
            sums = (total[bounds[1:]] - total[bounds[:-1]]).reshape(n1, n2)
            group = np.arange(n1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
            for number, chosen in enumerate(_subsets(n2, n2 - k2)):
                out.append(mix(sums[:, chosen].sum(1, dtype=np.uint64) + group + np.uint64(((band << 20) + number + 1) * int(_MIX1) & 0xFFFFFFFFFFFFFFFF)))
        return np.unique(np.concatenate(out))


@lru_cache(None)
def _subsets(n: int, k: int) -> list[list[int]]:
    return [list(c) for c in combinations(range(n), k)]


# A set's reference: its block and its place there.
PLACE_BITS = 24


def _reference(block: int, place) -> int:
    return block << PLACE_BITS | place


SETS = "ref long, doc_id long, n long, a long, b long, sketch binary"


def parity_sketch(elements: np.ndarray) -> bytes:
    """Bit i is whether an odd number of elements falls on it: a power of two of bits, at least twice the set's size.

    The halves of a sketch combined by exclusive or are the sketch of half as many bits. The least and the largest
    number of bits bound its memory; a smaller sketch proves less but never too much.
    """
    bits = min(max(SKETCHES[0], 1 << (2 * len(elements) - 1).bit_length()), SKETCHES[1])
    return np.packbits((np.bincount((elements >> np.uint64(20)) % np.uint64(bits), minlength=bits) & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of several widths; rows() folds them to one."""

    def __init__(self, raw: list[bytes]):
        self.flat = np.frombuffer(b"".join(raw), np.uint64)
        self.widths = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
        self.starts = np.cumsum(self.widths) - self.widths

    def rows(self, at: np.ndarray, width: int) -> np.ndarray:
        out = np.empty((len(at), width), np.uint64)
        own = self.widths[at]
        for w in np.unique(own).tolist():
            m = np.flatnonzero(own == w)
            x = self.flat[self.starts[at[m]][:, None] + np.arange(w)]
            out[m] = x if w == width else np.bitwise_xor.reduce(x.reshape(len(m), w // width, width), axis=1)
        return out


def _classes(blocks: DataFrame, size: int) -> DataFrame:
    """ref, doc_id, number of shingles and a 128-bit key of the set of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts = Texts(payload.as_py())
                n, keys = np.zeros(len(texts.ids), np.int64), np.zeros((len(texts.ids), 2), np.uint64)
                sketches: list[bytes | None] = [None] * len(texts.ids)
                for i, s in shingle_sets(texts, size):
                    n[i] = len(s)
                    if len(s):
                        keys[i] = s.sum(dtype=np.uint64), mix(s ^ _MIX1).sum(dtype=np.uint64)
                        sketches[i] = parity_sketch(s)
                refs = _reference(block, np.arange(len(texts.ids), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(refs), texts.id_array(), pa.array(n), pa.array(keys[:, 0].view(np.int64)), pa.array(keys[:, 1].view(np.int64)), pa.array(sketches, pa.binary())], names=["ref", "doc_id", "n", "a", "b", "sketch"])

    return blocks.mapInArrow(run, SETS)


def _places(table: pa.Table, column: str = "ref") -> np.ndarray:
    return table.column(column).to_numpy() & ((1 << PLACE_BITS) - 1)


def _ask_signatures(blocks: DataFrame, chosen: DataFrame, bands: Bands, buckets: int, size: int) -> DataFrame:
    """Questions (bucket, block): signatures of the chosen documents with their references."""

    def body(block: int, texts: Texts, table: pa.Table) -> pa.Table:
        wanted = np.zeros(len(texts.ids), bool)
        wanted[_places(table)] = True
        signatures, counts, places = [], [], []
        for i, s in shingle_sets(texts, size):
            if wanted[i] and len(s):
                signatures.append(bands.signatures(s))
                counts.append(len(signatures[-1]))
                places.append(i)
        asks = []
        if places:
            every, owner = np.concatenate(signatures), np.repeat(np.array(places, np.int64), counts)
            bucket = (every % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            starts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                at = order[starts[k] : starts[k + 1]]
                if len(at):
                    h = every[at] >> np.uint64(16)  # 48 bits and the bucket: what agrees by chance is verified away
                    asks.append((k, pack((h & np.uint64(0xFFFFFFFF)).astype("<u4"), (h >> np.uint64(32)).astype("<u2"), np.diff(owner[at], prepend=0).astype("<u4"))))
        out = list(question_rows(block, asks))
        return pa.Table.from_batches(out) if out else pa.table({"key": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "payload": pa.array([], pa.binary())})

    return answered(blocks, chosen.select("ref", F.shiftright("ref", PLACE_BITS).alias("block")), body, QUESTION)


GROUPS = "gid long, ref long, first long"


def _groups(table: pa.Table) -> pa.Table:
    """The distinct groups of sets that share a signature of this bucket."""
    asked = in_order(table, "block")
    every = np.concatenate([low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32) for _, (low, high, _) in asked])
    refs = np.concatenate([_reference(block, np.cumsum(step, dtype=np.int64)) for block, (_, _, step) in asked])
    order = np.lexsort((refs, every))
    every, refs = every[order], refs[order]
    starts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    sizes = np.diff(np.append(starts, len(every)))
    refs, sizes = refs[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
    if not len(sizes):
        return pa.table({n: pa.array([], pa.int64()) for n in ("gid", "ref", "first")})
    # A group's name is a hash of its members; equal groups are returned once.
    name = mix(np.add.reduceat(mix(refs.view(np.uint64) + _MIX1), np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    _, first = np.unique(name, return_index=True)
    keep = np.zeros(len(sizes), bool)
    keep[first] = True
    keep = np.repeat(keep, sizes)
    least = np.repeat(refs[np.cumsum(sizes) - sizes], sizes)
    return pa.table({"gid": pa.array(np.repeat(name.view(np.int64), sizes)[keep]), "ref": pa.array(refs[keep]), "first": pa.array(least[keep])})


MEMBERS = "gid long, ref long, partner long, shared long"


def _split_groups(num: int, den: int):
    """Cut groups (a slot holds many) where the sketches allow; partner: the member of most possible links."""

    def bound(n, m):
        return (den - num) * (n + m) // (den + num)

    class Group:
        """Which members may be similar, by slices of members: memory is linear in the group's size."""

        def __init__(self, rows, n):
            self.rows, self.n, self.slice = rows, n, max(1, (1 << 22) // max(1, rows.size))

        def close(self, at):
            """For members `at`: a row of marks over all members, themselves excepted."""
            differ = np.bitwise_count(self.rows[at][:, None, :] ^ self.rows[None, :, :]).sum(2, dtype=np.int64)
            out = differ <= bound(self.n[at][:, None], self.n[None, :])
            out[np.arange(len(at)), at] = False
            return out

        def slices(self, at):
            for lo in range(0, len(at), self.slice):
                some = at[lo : lo + self.slice]
                yield some, self.close(some)

    def run(table: pa.Table) -> pa.Table:
        # A slot's rows are members of groups (no sketch) and the sketches of all sets that occur in them.
        is_group = table.column("sketch").is_null().to_numpy()
        every_ref, every_n = table.column("ref").to_numpy(), table.column("n").fill_null(0).to_numpy()
        known = np.flatnonzero(~is_group)
        known = known[np.argsort(every_ref[known], kind="stable")]
        sketches = Sketches(table.column("sketch").take(pa.array(known)).to_pylist())
        at = np.flatnonzero(is_group)
        gid, ref = table.column("gid").fill_null(0).to_numpy()[at], every_ref[at]
        order = np.lexsort((ref, gid))
        gid, ref = gid[order], ref[order]
        at = np.searchsorted(every_ref[known], ref)
        n, width = every_n[known][at], sketches.widths[at]
        starts = np.flatnonzero(np.append(True, gid[1:] != gid[:-1])) if len(gid) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(gid)))
        pairs = starts[sizes == 2]
        differ, least = np.zeros(len(pairs), np.int64), np.minimum(width[pairs], width[pairs + 1])
        for w in np.unique(least).tolist():
            some = np.flatnonzero(least == w)
            for lo in range(0, len(some), 1 + (1 << 20) // w):
                k = some[lo : lo + 1 + (1 << 20) // w]
                differ[k] = np.bitwise_count(sketches.rows(at[pairs[k]], w) ^ sketches.rows(at[pairs[k] + 1], w)).sum(1, dtype=np.int64)
        pairs = pairs[differ <= bound(n[pairs], n[pairs + 1])]
        # Of two, each is the other's partner; the least is written as both's.
        gids, refs = [np.repeat(gid[pairs], 2)], [np.stack([ref[pairs], ref[pairs + 1]], 1).ravel()]
        partners, shared = [np.repeat(ref[pairs], 2)], [np.ones(2 * len(pairs), np.int64)]
        for a, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            group = Group(sketches.rows(at[a : a + m], int(width[a : a + m].min())), n[a : a + m])
            degree = np.zeros(m, np.int64)
            for some, close in group.slices(np.arange(m)):
                degree[some] = close.sum(1)
            left = degree > 0
            while left.any():
                part, best = np.zeros(m, bool), np.zeros(m, np.int64)
                part[int(np.argmax(np.where(left, degree, -1)))] = True
                edge = np.flatnonzero(part)
                while len(edge):
                    reached = np.zeros(m, bool)
                    for some, close in group.slices(edge):
                        reached |= close.any(0)
                        best[some] = np.argmax(np.where(close, degree[None, :], -1), axis=1)
                    edge = np.flatnonzero(reached & ~part)
                    part[edge] = True
                own = np.flatnonzero(part)
                left[own] = False
                lead = own[np.argmax(degree[own])]
                # Links to the best connected member where they are possible, else to a member's best neighbour.
                direct = group.close(np.array([lead]))[0][own]
                direct[own == lead] = True
                gids.append(np.full(len(own), int(mix(np.array([gid[a] ^ int(ref[a + own[0]])], np.int64).view(np.uint64)).view(np.int64)[0])))
                refs.append(ref[a + own])
                partners.append(ref[a + np.where(direct, lead, best[own])])
                shared.append(degree[best[own]])
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in (("gid", gids), ("ref", refs), ("partner", partners), ("shared", shared))})

    return run


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, label): the least node of each connected component, for the nodes of edges (a, b).

    Every node's neighbours and the node itself are linked to the least of them until nothing changes: components
    become stars in about log(diameter) rounds. Each round is written to the shared folder.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).alias("m")
    before = now.agg(mark).first().m
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = staged(moved.where("a <> b").distinct(), name)
        after = now.agg(mark).first().m
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


SHIPPED = "k1 long, k2 long, k3 long, ref long, tag long, payload binary"


def _ship(blocks: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """wanted (k1, k2, k3, ref, tag) with each reference's set."""

    def body(block: int, texts: Texts, table: pa.Table) -> pa.Table:
        places = _places(table) if table.num_rows else np.zeros(0, np.int64)
        need = set(places.tolist())
        sets = {i: pack(s) for i, s in shingle_sets(texts, size) if i in need} if need else {}
        columns = {n: table.column(n) if table.num_rows else pa.array([], pa.int64()) for n in ("k1", "k2", "k3", "ref", "tag")}
        return pa.table(columns | {"payload": pa.array([sets[p] for p in places.tolist()], pa.binary())})

    return answered(blocks, wanted.withColumn("block", F.shiftright("ref", PLACE_BITS)), body, SHIPPED)


LINKS = "a long, b long"


def _sets(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    from .pitmanyor import unpack

    return table.column("ref").to_numpy(), table.column("tag").to_numpy(), [unpack(p.as_py())[0] for p in table.column("payload")]


def _link_table(a, b) -> pa.Table:
    return pa.table({"a": pa.array(np.asarray(a, np.int64)), "b": pa.array(np.asarray(b, np.int64))})


def similar(x: int, y: int, both, num: int, den: int):
    return den * both >= num * (x + y - both)


def _verify_partners(num: int, den: int):
    """Group (partner, salt): tag 1 is the partner, tag 0 the sets that chose it."""

    def run(table: pa.Table) -> pa.Table:
        refs, tags, sets = _sets(table)
        lead = int(np.flatnonzero(tags == 1)[0])
        own = sets[lead]
        linked = []
        for r, t, s in zip(refs.tolist(), tags.tolist(), sets, strict=True):
            if t == 0:
                both = int(np.isin(s, own, assume_unique=True).sum())
                if similar(len(s), len(own), both, num, den):
                    linked.append(r)
        return _link_table([refs[lead]] * len(linked), linked)

    return run


def _compare_chunks(num: int, den: int):
    """Group (cluster, i, j): all pairs of sets of chunk i with chunk j that have different labels (tag) and are similar."""

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("k2")[0].as_py(), table.column("k3")[0].as_py()
        refs, labels, sets = _sets(table)
        # Which chunk a set is in follows from its reference; see _dealt.
        sizes = np.array([len(s) for s in sets], np.int64)
        _, element = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        # Elements of a single set meet nothing.
        times = np.bincount(element)
        more = np.flatnonzero(times > 1)
        column = np.full(len(times), -1)
        column[more] = np.arange(len(more))
        element = column[element]
        owner, element = owner[element >= 0], element[element >= 0]
        order = np.argsort(element, kind="stable")
        owner, element = owner[order], element[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for lo in range(0, len(more), 4096):
            p, q = np.searchsorted(element, [lo, lo + 4096])
            m = np.zeros((len(sets), min(4096, len(more) - lo)), np.float32)
            m[owner[p:q], element[p:q] - lo] = 1
            both += m @ m.T
        both = np.rint(both).astype(np.int64)
        hit = similar(sizes[:, None], sizes[None, :], both, num, den) & (labels[:, None] != labels[None, :])
        a, b = np.nonzero(np.triu(hit, 1))
        return _link_table(refs[a], refs[b])

    return run


def _dealt(unresolved: DataFrame, chunk: int) -> DataFrame:
    """Rows (k1 cluster, k2, k3, ref, tag) that deal each cluster's sets to the tasks of all pairs of its chunks."""
    sizes = unresolved.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(chunk)).cast("long").alias("chunks"))
    own = unresolved.join(sizes, "cluster").withColumn("c", F.pmod(F.xxhash64("ref"), "chunks"))
    # With one other chunk, or alone where there is only one.
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1), lambda o: o != F.col("c")))
    each = own.withColumn("o", F.explode(others))
    return each.select(F.col("cluster").alias("k1"), F.least("c", "o").alias("k2"), F.greatest("c", "o").alias("k3"), "ref", F.col("label").alias("tag"))


def _linked(blocks: DataFrame, size: int, similarity: tuple[int, int], chunk: int) -> tuple[DataFrame, DataFrame]:
    """Every row's ref, doc_id, n and set key (a, b); and of every set that is not empty its key, the component's least
    id (LAST_ID for none) and that row's reference."""
    num, den = similarity
    buckets, bands = shuffle_parts(blocks.sparkSession) * BUCKETS, Bands(num, den)
    sets = staged(_classes(blocks, size), "jaccard-sets")
    # The class's member with the least reference stands for it; equal sets are linked.
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(int(LAST_ID))).alias("id"), "ref"))
    classes = sets.where("n > 0").groupBy("a", "b", "n").agg(F.min("ref").alias("ref"), first.alias("least"))
    classes = staged(classes, "jaccard-classes")
    groups = staged(_ask_signatures(blocks, classes, bands, buckets, size).groupBy("key").applyInArrow(_groups, GROUPS), "jaccard-groups").distinct()
    # Groups with the same first member meet in a few slots, so that a set's sketch travels to few of them.
    slotted = staged(groups.withColumn("slot", F.pmod(F.xxhash64("first", F.pmod("gid", F.lit(4))), F.lit(buckets))).select("slot", "gid", "ref"), "jaccard-slots")
    sketches = slotted.select("slot", "ref").distinct().join(sets.select("ref", "n", "sketch"), "ref")
    drawn = slotted.select("slot", "gid", "ref", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("sketch")).unionByName(sketches.select("slot", F.lit(None).cast("long").alias("gid"), "ref", "n", "sketch"))
    members = staged(drawn.groupBy("slot").applyInArrow(_split_groups(num, den), MEMBERS), "jaccard-members")

    chosen = members.where("ref <> partner").groupBy("ref").agg(F.max_by(F.col("partner"), F.struct("shared", -F.col("partner"))).alias("partner"))
    chosen = staged(chosen, "jaccard-partners")
    # A partner's set goes once to a task for each FAN sets that chose it.
    fans = chosen.groupBy("partner").agg(F.ceil(F.count(F.lit(1)) / F.lit(FAN)).cast("long").alias("fan"))
    keyed = chosen.join(fans, "partner").withColumn("salt", F.pmod(F.xxhash64("ref"), "fan"))
    leads = keyed.select("partner", "salt").distinct()
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    wanted = keyed.select(F.col("partner").alias("k1"), F.col("salt").alias("k2"), zero.alias("k3"), "ref", zero.alias("tag")).unionByName(
        leads.select(F.col("partner").alias("k1"), F.col("salt").alias("k2"), zero.alias("k3"), F.col("partner").alias("ref"), one.alias("tag"))
    )
    links = staged(_ship(blocks, wanted, size).groupBy("k1", "k2").applyInArrow(_verify_partners(num, den), LINKS), "jaccard-links")
    labels = staged(components(links), "jaccard-labels")

    marked = members.select("gid", "ref").distinct().join(labels, F.col("ref") == F.col("node"), "left").select("gid", "ref", F.coalesce("label", "ref").alias("label"))
    marked = staged(marked, "jaccard-marked")
    open_groups = marked.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("ref").alias("first")).where("lo < hi").select("gid", "first")
    pending = staged(marked.join(open_groups, "gid").select("ref", "label", "first"), "jaccard-pending")
    clusters = components(pending.select(F.col("ref").alias("a"), F.col("first").alias("b")))
    unresolved = pending.select("ref", "label").distinct().join(clusters.select(F.col("node").alias("ref"), F.col("label").alias("cluster")), "ref")
    more = _ship(blocks, _dealt(staged(unresolved, "jaccard-open"), chunk), size).groupBy("k1", "k2", "k3").applyInArrow(_compare_chunks(num, den), LINKS)
    final = staged(components(links.unionByName(staged(more, "jaccard-links"))), "jaccard-labels")

    labelled = classes.join(final, F.col("ref") == F.col("node"), "left").select("a", "b", "n", "least", F.coalesce("label", "ref").alias("label"))
    labelled = staged(labelled, "jaccard-classes")
    ids = labelled.groupBy("label").agg(F.min("least").alias("component"))
    return sets.select("ref", "doc_id", "n", "a", "b"), labelled.join(ids, "label").select("a", "b", "n", F.col("component.id").alias("component"), F.col("component.ref").alias("keeper"))


def jaccard_components(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILAR, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n_shingles and component_id (least id that links reach) of every document."""
    blocks = text_blocks(docs, id=id, text=text, block_bytes=BLOCK, level=7)
    sets, named = _linked(blocks, size, similarity, chunk)
    with_words = sets.where("n > 0").join(named, ["a", "b", "n"]).select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("component") != int(LAST_ID), F.col("component")).alias("component_id"))
    return with_words.unionByName(sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILAR, chunk: int = CHUNK
) -> DataFrame:
    """docs' own rows and columns, one row of each component: that with the least id (null ids last, ties by place).

    Rows without words are linked with nothing and stay. Rows are told apart by their place, so a repeated id loses no
    other text. Documents are packed with all their columns; only the places to drop travel to them.
    """
    columns = docs.columns
    carry = [c for c in columns if c != text]
    blocks = text_blocks(docs, id=id, text=text, block_bytes=BLOCK, level=7, carry=carry)
    sets, named = _linked(blocks, size, similarity, chunk)
    gone = sets.where("n > 0").join(named, ["a", "b", "n"]).where("ref <> keeper").select("ref", F.shiftright("ref", PLACE_BITS).alias("block"))

    def body(block: int, texts: Texts, table: pa.Table) -> pa.Table:
        keep = np.ones(len(texts.ids), bool)
        if table.num_rows:
            keep[_places(table)] = False
        at = np.flatnonzero(keep)
        out = {c: x.take(pa.array(at)) for c, x in zip(carry, texts.rest(), strict=True)}
        out[text] = pa.array([texts.text(i) for i in at.tolist()], pa.string())
        return pa.table({c: out[c] for c in columns})

    return answered(blocks, gone, body, docs.schema)
