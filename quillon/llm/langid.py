"""Language identification of words by a linear-chain conditional random field.

A word's features are its n-grams (with the word's borders, so that they hold its affixes) and the word itself (the
lexicon). Transition weights between the languages of neighbouring words are learned with them. Every word gets
posterior probabilities by forward-backward; a document's language is the one with the largest mean posterior, so
texts that switch language are read word by word.

The recursions are exact over whole texts: a text is cut in segments whose transfer matrices are multiplied out first,
which lets all segments of a batch advance together.

The model is fitted on at most `sample` training rows, the first by a hash of their id. Languages are the learned
values; `und` is returned where a text is null or has no letter. Repeated rows are predicted each; a table without a
labelled row gives `und` with score 0 everywhere; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import byte_slices

UNDETERMINED = "und"
SAMPLE = 800
BITS = 15
GRAMS = (2, 3, 4)
SEGMENT = 64
ROUNDS = 14

_LETTER = re.compile(r"[^\W\d_]")
_SPACE = np.uint8(32)
#: ASCII bytes that aren't letters separate words; all bytes of other characters count as letters.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
_MIX = np.uint32(2654435761)


class Words:
    """The words of a batch of texts: for each feature its word and its hash; for each text the range of its words."""

    def __init__(self, texts: list[str | None]):
        low = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
        joined = _FOLD[np.frombuffer(b" " + b" ".join(low) + b"    ", np.uint8)]
        begins = np.concatenate([[1], 1 + np.cumsum([len(x) + 1 for x in low])])[:-1] if low else np.zeros(0, np.int64)
        letter = joined != _SPACE
        self.starts = np.flatnonzero(letter[1:] & ~letter[:-1]) + 1
        self.ends = np.flatnonzero(letter[:-1] & ~letter[1:]) + 1
        self.first = np.searchsorted(self.starts, begins)
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.bytes, self.letter = joined, letter

    def __len__(self) -> int:
        return len(self.starts)

    def features(self) -> Iterator[np.ndarray]:
        """For each kind of feature, a hash at every byte, or the empty feature where there is none.

        A byte's features belong to the word it is in; a border before a word belongs to the word after it.
        """
        b, n = self.bytes.astype(np.uint32), len(self.bytes)
        inner = self.letter
        for size in GRAMS:
            code = np.zeros(n, np.uint32)
            m = n - size + 1
            for k in range(size):
                code[:m] = code[:m] * np.uint32(0x01000193) ^ b[k : k + m]
            h = ((code * _MIX) ^ np.uint32(size)) >> np.uint32(32 - BITS)
            whole = np.zeros(n, bool)
            whole[:m] = True
            for k in range(1, size - 1):  # only the first and the last may be a border
                whole[:m] &= inner[k : k + m]
            whole[:m] &= (inner[:m] | inner[1 : 1 + m]) if size > 2 else (inner[:m] | inner[1 : 1 + m])
            yield np.where(whole, h.astype(np.int32) + 1, 0)
        word = np.zeros(n, np.int32)
        if len(self):
            place = np.arange(n, dtype=np.uint64)
            owner = np.cumsum(np.bincount(self.starts, minlength=n)[:n]) - 1
            place -= self.starts[np.maximum(owner, 0)].astype(np.uint64)
            terms = (b.astype(np.uint64) + np.uint64(7)) * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)) * inner
            sums = np.add.reduceat(terms, self.starts) * np.uint64(0xD6E8FEB86659FD93)
            word[self.starts] = (sums >> np.uint64(64 - BITS)).astype(np.int32) + 1 + (1 << BITS)
        yield word

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """weights[hash] summed over each word's features: an array of words x labels."""
        total = np.zeros((len(self), weights.shape[1]), np.float32)
        if len(self):
            for h in self.features():
                total += np.add.reduceat(np.take(weights, h, axis=0), self.starts - 1, axis=0)
        return total

    def distinct(self) -> tuple[Words, np.ndarray]:
        """The distinct words (by a 64-bit hash) as Words of their own, and the number of each word in them."""
        if not len(self):
            return self, np.zeros(0, np.int64)
        size = self.ends - self.starts
        power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        data = self.bytes[self.letter]
        sums = np.add.reduceat((data + np.uint64(1)) * power[place], np.cumsum(size) - size) * np.uint64(0xD6E8FEB86659FD93)
        _, at, back = np.unique(sums ^ (sums >> np.uint64(29)), return_index=True, return_inverse=True)
        own, n = Words([]), size[at]
        ends = 1 + np.cumsum(n + 1)
        own.starts, own.ends = ends - n - 1, ends - 1
        own.bytes = np.full(int(ends[-1]) + 4, _SPACE)
        own.letter = np.zeros(len(own.bytes), bool)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        into = np.repeat(own.starts, n) + within
        own.bytes[into] = self.bytes[np.repeat(self.starts[at], n) + within]
        own.letter[into] = True
        return own, back

    def spread(self, values: np.ndarray, size: int) -> np.ndarray:
        """The transpose of sums: each word's values added to all its features."""
        out = np.zeros((size, values.shape[1]))
        owner = np.cumsum(np.bincount(self.starts - 1, minlength=len(self.bytes))) - 1
        for h in self.features():
            at = np.flatnonzero((h > 0) & (owner >= 0))
            for label in range(values.shape[1]):
                out[:, label] += np.bincount(h[at], values[owner[at], label], minlength=size)
        return out


def posteriors(energy: np.ndarray, counts: np.ndarray, transition: np.ndarray, *, pairs: bool = False):
    """Forward-backward over chains of `counts` words whose emission energies follow one another.

    Returns each word's label probabilities and, with pairs, the expected number of each transition.
    """
    labels = energy.shape[1]
    step = np.exp(transition - transition.max())
    emit = np.exp(energy - energy.max(1, keepdims=True)) if len(energy) else energy
    segments = -(-counts // SEGMENT)
    chain = np.repeat(np.arange(len(counts)), segments)
    order = np.arange(len(chain)) - np.repeat(np.cumsum(segments) - segments, segments)
    begin = np.repeat(np.cumsum(counts) - counts, segments) + order * SEGMENT
    size = np.minimum(SEGMENT, counts[chain] - order * SEGMENT)
    n = len(chain)
    if not n:
        return (np.zeros((0, labels)), np.zeros((labels, labels))) if pairs else np.zeros((0, labels))
    # Longest segments first: those that a step still reaches are a prefix.
    by_size = np.argsort(-size, kind="stable")
    place = np.empty(n, np.int64)
    place[by_size] = np.arange(n)
    at_step = np.arange(SEGMENT)[:, None]
    live = (size[by_size] > at_step).sum(1)
    grid = np.minimum(begin[by_size] + at_step, len(emit) - 1)
    e = np.take(emit, grid, axis=0)

    # Transfer matrix of each segment.
    matrix = np.broadcast_to(np.eye(labels), (n, labels, labels)).copy()
    for t in range(int(size.max())):
        k = live[t]
        m = (matrix[:k].reshape(-1, labels) @ step).reshape(k, labels, labels)
        m *= e[t, :k, None, :]
        if t % 8 == 7:
            m /= m.reshape(k, -1).max(1)[:, None, None]
        matrix[:k] = m
    matrix = matrix[place]
    enter, leave = np.full((n, labels), 1.0 / labels), np.ones((n, labels))
    offset = np.cumsum(segments) - segments
    longest = int(segments.max())
    for k in range(1, longest):
        at = offset[segments > k] + k
        a = np.einsum("ni,nij->nj", enter[at - 1], matrix[at - 1])
        enter[at] = a / a.sum(1, keepdims=True)
    for k in range(longest - 2, -1, -1):
        at = offset[segments > k + 1] + k
        z = np.einsum("nij,nj->ni", matrix[at + 1], leave[at + 1])
        leave[at] = z / z.max(1, keepdims=True)
    enter, leave, later = enter[by_size], leave[by_size], order[by_size] > 0
    alpha = np.empty((SEGMENT, n, labels))
    a = enter
    for t in range(int(size.max())):
        k = live[t]
        a = (a[:k] @ step) * e[t, :k]
        a /= a.sum(1, keepdims=True)
        alpha[t, :k] = a
    gamma = np.empty((len(emit), labels))
    expected = np.zeros((labels, labels))
    z = leave.copy()
    for t in range(int(size.max()) - 1, -1, -1):
        k = live[t]
        g = alpha[t, :k] * z[:k]
        gamma[grid[t, :k]] = g / g.sum(1, keepdims=True)
        into = e[t, :k] * z[:k]
        if pairs:
            previous = alpha[t - 1, :k] if t else enter[:k]
            joint = previous[:, :, None] * step * into[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            expected += (joint if t else joint[later[:k]]).sum(0)
        back = into @ step.T
        z[:k] = back / back.max(1, keepdims=True)
    return (gamma, expected) if pairs else gamma


def fit(texts: list[str], languages: list[str], *, rounds: int = ROUNDS, l2: float = 1e-4, rate: float = 0.5) -> dict:
    """Emission and transition weights by full-batch AdaGrad on the conditional likelihood.

    Each training chain joins a text's words with a piece of another text's, so that switches occur in training.
    """
    names = sorted(set(languages))
    if not names:
        return {"languages": [], "weights": None, "transition": None}
    order = np.random.default_rng(11).permutation(len(texts))
    words = Words([texts[i] for i in order])
    label = np.repeat([names.index(languages[i]) for i in order], words.counts)
    total = len(words)
    # Chains of about 200 words run across the borders of texts.
    counts = np.full(-(-total // 200), 200)
    if len(counts):
        counts[-1] = total - 200 * (len(counts) - 1)
    size = (2 << BITS) + 1
    weights, transition = np.zeros((size, len(names)), np.float32), np.zeros((len(names), len(names)))
    past_w, past_t = np.full(weights.shape, 1e-6), np.full(transition.shape, 1e-6)
    truth = np.eye(len(names))[label]
    chain = np.repeat(np.arange(len(counts)), counts)
    same = chain[1:] == chain[:-1]
    seen = np.zeros_like(transition)
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    own, which = words.distinct()
    for _ in range(rounds if total else 0):
        gamma, pairs = posteriors(own.sums(weights)[which].astype(float), counts, transition, pairs=True)
        miss = np.stack([np.bincount(which, d, minlength=len(own)) for d in (truth - gamma).T], 1)
        g = own.spread(miss, size) / total - l2 / total * weights
        g[0] = 0
        past_w += g * g
        weights += (rate * g / np.sqrt(past_w)).astype(np.float32)
        gt = (seen - pairs) / total - l2 * transition
        past_t += gt * gt
        transition += rate * gt / np.sqrt(past_t)
    return {"languages": names, "weights": weights, "transition": transition}


def train(docs: DataFrame, where: Column, *, id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> dict:
    """Fit on at most `sample` of the rows that meet `where` and have a text and a language, the first by a hash of their id."""
    rows = docs.where(where & F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(id).cast("long").alias("i"), F.col(lang).cast("string").alias("l"), F.col(text).cast("string").alias("t"))
    ids = rows.select(F.xxhash64("i").alias("h"), "i").orderBy("h", "i").limit(sample).agg(F.max("h")).first()[0]
    found = rows.where(F.xxhash64("i") <= F.lit(ids)).orderBy(F.xxhash64("i"), "i", "l", "t").limit(sample).collect() if ids is not None else []
    return fit([r.t for r in found], [r.l for r in found])


SLICE = 1 << 20  # characters whose features are in memory at once (one text at least)


def predict_batch(texts: list[str | None], model: dict) -> tuple[list[str], list[float], list[int], list[float]]:
    """Of each text: language, its mean posterior over the words, words, and the mean of the words' largest posteriors."""
    names = model["languages"]
    langs, scores, sizes, sure = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0] * len(texts), [0.0] * len(texts)
    if not names:
        return langs, scores, sizes, sure
    energies, counts = [], []
    for lo, hi in byte_slices(texts, SLICE):
        words = Words(texts[lo:hi])
        own, which = words.distinct()
        energies.append(own.sums(model["weights"])[which])
        counts.append(words.counts)
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    energy = np.concatenate(energies) if energies else np.zeros((0, len(names)))
    full = np.flatnonzero(count)
    gamma = posteriors(energy, count[full], model["transition"])
    average = lambda x: np.add.reduceat(x, np.cumsum(count[full]) - count[full], axis=0) / count[full][:, None] if len(full) else x
    for i, p, q in zip(full.tolist(), average(gamma), average(gamma.max(1, keepdims=True)), strict=True):
        if _LETTER.search(texts[i]):
            k = int(p.argmax())
            langs[i], scores[i], sizes[i], sure[i] = names[k], float(min(1.0, p[k])), int(count[i]), float(min(1.0, q[0]))
    return langs, scores, sizes, sure


def identify(docs: DataFrame, model: dict, *, id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, n_words and certainty (the mean of the words' largest posteriors) of every whole text, or
    the columns `keep` with those four after them."""
    names = keep if keep is not None else [id]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** (BITS + 1) weights a language, whatever the input
    more = [] if text in names else [F.col(text).cast("string").alias("text__")]
    at_text = names.index(text) if text in names else len(names)
    width = len(names)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema.fields), "lang_pred string, score double, n_words long, certainty double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                some = b.slice(at, 1024)
                texts = some.column(at_text).to_pylist()
                for lo, hi in byte_slices(texts, SLICE):
                    found = predict_batch(texts[lo:hi], m)
                    yield pa.RecordBatch.from_arrays(
                        [*(some.column(i).slice(lo, hi - lo) for i in range(width)), *(pa.array(x, kind) for x, kind in zip(found, (pa.string(), pa.float64(), pa.int64(), pa.float64()), strict=True))],
                        names=[*b.schema.names[:width], "lang_pred", "score", "n_words", "certainty"],
                    )

    return docs.select(*names, *more).mapInArrow(run, schema)


#: Documents whose words are less certain than this on average, and those without a letter, are rejected by the filter.
MIN_CERTAINTY = 0.4


def filter_languages(docs: DataFrame, model: dict, *, text: str = "text", languages: list[str] | None = None, min_certainty: float = MIN_CERTAINTY) -> DataFrame:
    """The rows of docs in one of the learned (or given) languages, with docs' own columns.

    A text that is spread over several languages stays as long as its words are certain of one language each.
    """
    wanted = languages if languages is not None else model["languages"]
    renamed = docs.toDF(*[f"c{i}__" for i in range(len(docs.columns))])
    own = renamed.columns[docs.columns.index(text)]
    found = identify(renamed, model, text=own, keep=renamed.columns)
    return found.where(F.col("lang_pred").isin(wanted) & (F.col("certainty") >= min_certainty)).select(*renamed.columns).toDF(*docs.columns)
