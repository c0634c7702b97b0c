"""Toxicity by a weighted finite-state pattern grammar.

A text is read clause by clause as a string of word classes (insult, threat, target, negation, report, other).
Transducers for negation, reported speech and targets rewrite that string; a last one emits the matched patterns. Their
composition is run as one machine. A document's score is a logistic function of its matched clauses.

The insult stems (with weights) and the logistic weights are learned from at most `sample` labelled rows, those that
come first by a hash of their id. The word classes that language fixes (targets, negations, ...) are given below.

Defined cases: null and empty texts match nothing and get the score of a text without a match; a table without labels
gives the prior's score; repeated rows are scored each; null labels are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word classes of English, German, French and Spanish.
TARGET = "you your youre u he she they them him her this that du dich dir ihr sie er tu te toi vous il elle ils usted tú ti él ella ellos".split()
NEGATION = "not no never isn't aren't wasn't don't nicht kein keine nie pas jamais ni nunca jamás".split()
REPORT = "said says say wrote writes claimed called reported quote quoted sagte schrieb dit disait écrit dijo escribió".split()
THREAT = "kill murder destroy hurt stab shoot beat burn hang töten umbringen tuer frapper matar golpear".split()
INSULT = "idiot moron stupid scum loser worthless pathetic disgusting trash clown".split()

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
_BREAK = frozenset(".!?;:\n")
_LETTER = re.compile(r"[^\W\d_]")
REACH = 3  # words that a negation before them covers


class _Flat(dict):
    """A table for str.translate: whatever is no letter to _TOKEN becomes a space; filled as characters are met."""

    def __missing__(self, c: int) -> int | str:
        self[c] = out = c if _LETTER.match(chr(c)) else " "
        return out


_FLAT = _Flat()


class Composed:
    """Transducers run one after another; the product machine's arcs are made as they are needed."""

    def __init__(self, *machines):
        self.machines = machines
        self.arcs: dict = {}
        self.start = tuple(0 for _ in machines)

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str]:
        if (arc := self.arcs.get((state, symbol))) is None:
            out, after = symbol, []
            for machine, s in zip(self.machines, state, strict=True):
                s, out = machine(s, out)
                after.append(s)
            arc = self.arcs[state, symbol] = (tuple(after), out)
        return arc


def negation(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "negation":
        return REACH, symbol
    return max(0, state - 1), f"{symbol}~" if state and symbol in ("insult", "threat") else symbol


def reported(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "report":
        return 1, symbol
    return state, f"{symbol}'" if state and symbol.rstrip("~") in ("insult", "threat") else symbol


def targeted(state: int, symbol: str) -> tuple[int, str]:
    if symbol == "target":
        return 1, symbol
    return state, f"{symbol}+" if state and symbol.rstrip("~'") in ("insult", "threat") else symbol


PATTERNS = [f"{a}{b}{c}{d}" for a in ("insult", "threat") for b in ("", "~") for c in ("", "'") for d in ("", "+")]
FEATURES = [*PATTERNS, "weight", "clauses", "any_insult", "any_threat"]
_GRAMMAR = Composed(negation, reported, targeted)


class Grammar:
    """stems: stem -> weight; a word that begins with a stem (or equals a whole word, written stem$) is an insult."""

    def __init__(self, stems: dict[str, float]):
        import ahocorasick

        self.stems = stems
        self.classes = {w: k for k, ws in (("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("threat", THREAT)) for w in ws}
        self.finder = ahocorasick.Automaton()
        for w in [f" {s.rstrip('$')}" for s in stems] + [f" {t} " for t in THREAT]:
            self.finder.add_word(w, w)
        self.finder.make_automaton()
        self.sizes = sorted({len(s) for s in stems if s[-1] != "$"})
        sizes = self.sizes

        @lru_cache(100_000)
        def insult_weight(word: str) -> float | None:  # holds no self: a grammar goes with its task, not with the next full collection
            if (w := stems.get(f"{word}$")) is not None:
                return w
            found = [stems[word[:n]] for n in sizes if word[:n] in stems]
            return max(found) if found else None

        self.insult_weight = insult_weight

    def read(self, text: str | None) -> list[float] | None:
        """The features of a text, or None if no clause can match."""
        if not text:
            return None
        low = text.lower()
        flat = f" {low.translate(_FLAT)} "
        if next(self.finder.iter(flat), None) is None:
            return None
        seen = dict.fromkeys(FEATURES, 0.0)
        clause: list[tuple[str, float]] = []
        for token in [*_TOKEN.findall(low), "."]:
            if token not in _BREAK:
                weight = self.insult_weight(token)
                clause.append(("insult", weight) if weight is not None else (self.classes.get(token, "other"), 0.0))
                continue
            if any(s in ("insult", "threat") for s, _ in clause):
                state, seen["clauses"] = _GRAMMAR.start, seen["clauses"] + 1
                # A report or a target can follow what it governs: these are read first.
                for s, _ in clause:
                    if s in ("report", "target"):
                        state, _ = _GRAMMAR.step(state, s)
                for s, weight in clause:
                    state, out = _GRAMMAR.step(state, s)
                    if out in seen:
                        seen[out] += 1
                        seen["weight"] += weight
            clause = []
        seen["any_insult"] = float(any(seen[p] for p in PATTERNS if p.startswith("insult")))
        seen["any_threat"] = float(any(seen[p] for p in PATTERNS if p.startswith("threat")))
        return [np.log1p(max(0.0, v)) for v in seen.values()]


STEM_CHARS = (3, 9)
SAMPLE = 6000


def labelled_sample(docs: DataFrame, labels: DataFrame, *, id: str, text: str, label: str, sample: int) -> DataFrame:
    """At most `sample` labelled rows (doc_id, text, y), the first by a hash of the id."""
    marks = labels.select(F.col(id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y is not null and doc_id is not null")
    first = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(sample)
    own = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.join(F.broadcast(first), "doc_id")  # at most `sample` pairs of numbers


def learn_stems(rows: DataFrame, *, min_docs: int = 8, min_odds: float = 2.0) -> dict[str, float]:
    """Stems and whole words whose documents are labelled toxic far more often than others, with their log odds.

    Counts are of the sample's documents, which also bounds the stems that come to the driver: each occurs in min_docs of
    them. Of nested stems, the longest stays unless a shorter one covers more documents.
    """
    low, high = STEM_CHARS
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    stems = F.flatten(F.transform(words, lambda w: F.array_append(F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.length(w)))), lambda n: F.substr(w, F.lit(1), n)), F.concat(w, F.lit("$")))))
    per_doc = rows.select("y", F.explode(F.array_distinct(stems)).alias("stem")).where(F.length("stem") >= low)
    totals = rows.agg(F.sum("y").alias("t"), F.count(F.lit(1)).alias("n")).first()
    toxic, clean = (totals.t or 0), (totals.n or 0) - (totals.t or 0)
    if not toxic or not clean:
        return {f"{w}$": 2.0 for w in INSULT}
    odds = F.log((F.col("a") + 0.5) / (toxic + 1.0)) - F.log((F.col("b") + 0.5) / (clean + 1.0))
    counted = per_doc.groupBy("stem").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    # With one clean document in four allowed, a stem has to be telling by itself.
    best = counted.where((F.col("a") >= min_docs) & (F.col("b") * 4 <= F.col("a"))).withColumn("odds", odds).where(F.col("odds") >= min_odds)
    out: dict[str, float] = {}
    support: dict[str, int] = {}
    # Most documents first, and of equally frequent stems the longest; a stem has to add to its accepted extensions.
    for r in sorted(best.collect(), key=lambda r: (-r.a, -len(r.stem), r.stem)):
        word = r.stem.rstrip("$")
        longer = sum(n for s, n in support.items() if s.startswith(word))
        shorter = any(word.startswith(s) for s in out if s[-1] != "$")
        if longer < 0.8 * r.a and not shorter:
            out[r.stem], support[r.stem] = float(r.odds), r.a
    return {f"{w}$": 2.0 for w in INSULT} | out


def fit_logistic(x: np.ndarray, y: np.ndarray, *, l2: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the last is the intercept) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 1.0) / (len(y) - y.sum() + 1.0))
    ridge = l2 * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _features(rows: DataFrame, stems: dict[str, float]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        for b in batches:
            found = [grammar.read(t.as_py()) or [0.0] * len(FEATURES) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(found, pa.list_(pa.float64()))], names=["y", "x"])

    return rows.select("text", "y").mapInArrow(run, "y int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> dict:
    """The model: stems with their weights, and the logistic weights. Learns from `sample` labelled rows at most."""
    rows = labelled_sample(docs, labels, id=id, text=text, label=label, sample=sample).repartition(docs.sparkSession.sparkContext.defaultParallelism * 2).persist()
    try:
        stems = learn_stems(rows)
        seen = _features(rows, stems).collect()
    finally:
        rows.unpersist()
    x = np.array([r.x for r in seen], float).reshape(-1, len(FEATURES))
    y = np.array([r.y for r in seen], float)
    order = np.lexsort((*x.T, y))  # the same sums whatever order the rows came in
    return {"stems": stems, "weights": fit_logistic(x[order], y[order])}


def score(docs: DataFrame, model: dict, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.5) and the number of matched clauses of every whole text."""
    stems, weights = model["stems"], np.asarray(model["weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(stems)
        none = float(1 / (1 + np.exp(-weights[-1])))
        at = FEATURES.index("clauses")
        for b in batches:
            scores, clauses = [], []
            for t in b.column(1):
                x = grammar.read(t.as_py())
                scores.append(none if x is None else float(1 / (1 + np.exp(-(np.dot(x, weights[:-1]) + weights[-1])))))
                clauses.append(0 if x is None else round(np.expm1(x[at])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(clauses, pa.int64())], names=["doc_id", "score", "predicted", "n_clauses"]
            )

    return docs.select(F.col(id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, n_clauses long")
