"""Byte-level BPE ids of whole texts, with a bounded memory of words."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np

#: A place before a space that is followed by something else than white space always ends a pre-token.
_SAFE = re.compile(r"(?= \S)")
_UNSAFE = re.compile(r" (?=\s)| \Z")


#: Punctuation that forms one pre-token after letters (an apostrophe could begin another kind).
TAIL = ".,;:!?#$%&*|"


def byte_slices(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 64
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _Memo(dict):
    """Word -> index. A key (word,) is a word at a text's start; any other is preceded by a space."""

    def __init__(self):
        self.new: list = []

    def __missing__(self, key):
        self[key] = i = len(self)
        self.new.append(key)
        return i


def _byte_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE file of `tokenizers` as bytes -> id, where an id is also its merge's rank."""
    vocabulary = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if all(c in byte for c in token)}


def _merger(path: str):
    """A function from the bytes of one pre-token to its ids."""
    import tiktoken

    ranks = _byte_ranks(path)
    special = max(ranks.values()) + 1
    ranks = {k: v for k, v in ranks.items() if k != b"<|endoftext|>"}
    return tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={"\x00": special})._core_bpe.encode_single_piece


class WordTokenizer:
    """Encodes texts as `tokenizers` does, but each distinct word once.

    Words of letters alone are single pre-tokens; for them the same merges run in `tiktoken`, which makes no encoding
    objects. All other words go through `tokenizers` itself.

    The pre-tokenizer of a byte-level BPE never joins characters across a space that precedes a non-space, so a text's
    ids are those of its space-separated words, one after another. Texts with runs of white space are cut at the safe
    places only. The model's special tokens are recognised in texts, as that library does; they hold a mark that is
    neither a letter nor in TAIL, so words with one always go through the library. At most max_words words are remembered.
    """

    def __init__(self, path: str, max_words: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.piece = _merger(path)
        self.max_words = max_words
        self._reset()

    def _reset(self) -> None:
        self.memo = _Memo()
        self.flat = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int32)
        self.uses = np.zeros(1 << 16, np.int64)

    def _forget(self) -> None:
        """Keep the words used most, half of max_words at most."""
        keys, n = list(self.memo), len(self.memo)
        keep = np.sort(np.argsort(-self.uses[:n], kind="stable")[: self.max_words // 2])
        keep = keep[self.uses[keep] > 2]
        start, length, uses, flat = self.start[keep], self.length[keep].astype(np.int64), self.uses[keep], self.flat
        self._reset()
        self.memo.update((keys[i], j) for j, i in enumerate(keep.tolist()))
        ends = np.cumsum(length)
        self.used = int(ends[-1]) if len(ends) else 0
        self._reserve(self.used)
        self.flat[: self.used] = flat[np.repeat(start - (ends - length), length) + np.arange(self.used)]
        self.start[: len(keep)], self.length[: len(keep)], self.uses[: len(keep)] = ends - length, length, uses // 2

    def _reserve(self, ids: int) -> None:
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        while len(self.memo) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros(len(self.start), np.int64)])
            self.length = np.concatenate([self.length, np.zeros(len(self.length), np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(self.uses), np.int64)])

    def _plain(self, word) -> list[int] | None:
        """The ids of a word of letters with punctuation after it, or of such lines; None if it is none of these."""
        lines, lead = (word[0], "") if type(word) is tuple else (word, " ")
        out: list[int] = []
        for i, line in enumerate(lines.split("\n")):
            head = line.rstrip(TAIL)
            if not head.isalpha():
                return None
            if i:
                out += self.piece(b"\n")
            out += self.piece((lead + head).encode())
            if len(head) < len(line):
                out += self.piece(line[len(head) :].encode())
            lead = ""
        return out

    def _learn(self) -> None:
        new, memo = self.memo.new, self.memo
        if not new:
            return
        first = len(memo) - len(new)
        piece = self.piece
        ids: list = [piece((" " + w).encode()) if type(w) is str and w.isalpha() else self._plain(w) for w in new]
        other = [i for i, x in enumerate(ids) if x is None]
        strings = [w[0] if type(w := new[i]) is tuple else " " + w for i in other]
        for i, e in zip(other, self.tokenizer.encode_batch_fast(strings, add_special_tokens=False), strict=True):
            ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        total = int(lengths.sum())
        self._reserve(self.used + total)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(ids), np.int32, total)
        self.length[first : len(memo)] = lengths
        self.start[first : len(memo)] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        memo.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (int32), and the number of each text's ids. A null text has none."""
        if len(self.memo) > self.max_words:
            self._forget()
        words: list = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if not text:
                continue
            if _UNSAFE.search(text):
                parts = _SAFE.split(text)
                parts = [(parts[0],), *(p[1:] for p in parts[1:])]
            else:
                parts = text.split(" ")
                parts[0] = (parts[0],)
            counts[k] = len(parts)
            words += parts
        codes = np.fromiter(map(self.memo.__getitem__, words), np.int32, len(words))
        self._learn()
        self.uses[: len(self.memo)] += np.bincount(codes, minlength=len(self.memo))
        lengths = self.length[codes].astype(np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[codes] - (ends - lengths), lengths)
        at += np.arange(total)
        ids = self.flat[at]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return ids, np.diff(upto)
