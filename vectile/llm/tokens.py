"""Token ids of whole text columns, with the tokenizers library run once on each distinct stretch of text.

A text is cut only where the pre-tokenizers of both vocabularies always end a token: before a single space that a
visible character follows, between an ASCII letter and a following mark, and around a lone line break. Stretches
are then tokenized apart from each other with the same ids as the whole text. A process keeps the stretches it has
seen, up to a bound; beyond it, those that were met again.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from vectile.llm import words as W

KEEP = 800_000  # distinct stretches a process remembers, and those of one piece of text
TOGETHER = 64  # plain words a call to the library takes as one text
AT_ONCE = 4096  # stretches tokenized at once; the library's own result takes far more room than the ids

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True
_VISIBLE = np.zeros(256, dtype=bool)  # bytes that surely begin a character that is no white space
_VISIBLE[33:127] = True
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False
_SOLID = np.zeros(256, dtype=bool)
_SOLID[33:127] = True


class Encoder:
    """Ids of one vocabulary file. ``fold``: the vocabulary ignores case, so A-Z may be lowered beforehand."""

    def __init__(self, path: str, fold: bool = False):
        self.path, self.fold = path, fold
        self._tokenizer = None

    def __reduce__(self):
        return (_shared, (self.path, self.fold))

    def _reset(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.entry = np.zeros(0, dtype=np.int32)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)
        self.again = np.zeros(0, dtype=bool)

    def _forget(self) -> None:
        """Drops the stretches not met again since the last time; all, if that doesn't halve them."""
        kept, entry = self.hashes[self.again], self.entry[self.again]
        if 2 * len(kept) > KEEP:
            return self._reset()
        size = self.offsets[entry + 1] - self.offsets[entry]
        self.ids = self.ids[W.ranges(self.offsets[entry], size)]
        self.offsets = np.concatenate([[0], np.cumsum(size)])
        self.hashes, self.entry = kept, np.arange(len(kept), dtype=np.int32)
        self.again = np.zeros(len(kept), dtype=bool)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if self._tokenizer is None:
            # Spark's tasks share out the cores; threads of the library's own would each keep memory
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
        sizes, flat = [], []
        for lo in range(0, len(texts), AT_ONCE):
            found = _encoded(self._tokenizer, texts[lo : lo + AT_ONCE])
            sizes.append(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), dtype=np.uint32, count=int(sizes[-1].sum())))
        new = (len(self.offsets) - 1 + np.arange(len(texts))).astype(np.int32)
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate([self.ids, *flat])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.entry = np.insert(self.entry, at, new)
        self.again = np.insert(self.again, at, False)

    def encode(self, col) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, bounds of each row); null and empty texts have none."""
        if self._tokenizer is None:
            self._reset()
        elif len(self.hashes) > KEEP:
            self._forget()
        buf, rows = W.flat(col)
        if self.fold and b"<|" not in buf.tobytes():
            plain = np.ones(len(buf), dtype=bool)  # a letter before a combining mark is left to the library
            plain[:-1] = buf[1:] < 128
            buf = np.where(plain, W._LOWER[buf], buf)
        start = _stretches(buf, rows)
        if not len(start):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(rows), dtype=np.int64)
        end = np.append(start[1:], len(buf))
        hashes, first, back = np.unique(W.span_hashes(buf, start, end), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        new = self.hashes[at] != hashes if len(self.hashes) else np.ones(len(hashes), dtype=bool)
        self.again[at[~new]] = True
        if new.any():
            data = buf.tobytes()
            texts = [data[s:e].decode("utf-8", "replace") for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            self._learn(hashes[new], texts)
            at = np.searchsorted(self.hashes, hashes)
        entry = self.entry[at][back]
        size = self.offsets[entry + 1] - self.offsets[entry]
        ids = self.ids[W.ranges(self.offsets[entry], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, total[np.searchsorted(start, rows)]


def _encoded(tokenizer, texts: list[str]) -> list[list[int]]:
    """The ids of each text. Words after a space are one pre-token each, so many of them go as one text."""
    out: list = [None] * len(texts)
    plain = [i for i, x in enumerate(texts) if x[0] == " " and x[1:].isalpha()]
    groups = [plain[s : s + TOGETHER] for s in range(0, len(plain), TOGETHER)]
    for group, found in zip(groups, tokenizer.encode_batch(["".join(texts[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
        ids, word = found.ids, found.word_ids
        if word[-1] != len(group) - 1:
            continue  # the library sees other words here; they go one by one
        for i in group:
            out[i] = []
        for x, k in zip(ids, word, strict=True):
            out[group[k]].append(x)
    rest = [i for i, x in enumerate(out) if x is None]
    for i, found in zip(rest, tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
        out[i] = found.ids
    return out


_ENCODERS: dict[tuple, Encoder] = {}


def _shared(path: str, fold: bool) -> Encoder:
    return _ENCODERS.setdefault((path, fold), Encoder(path, fold))


def _stretches(buf: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """First byte of each stretch."""
    n = len(buf)
    cut = np.zeros(n, dtype=bool)
    if not n:
        return np.zeros(0, dtype=np.int64)
    visible, solid = _VISIBLE[buf], _SOLID[buf]
    cut[:-1] = (buf[:-1] == 32) & visible[1:]
    cut[1:] |= _MARK[buf[1:]] & _LETTER[buf[:-1]]
    line = np.zeros(n, dtype=bool)
    line[1:-1] = (buf[1:-1] == 10) & solid[:-2] & visible[2:]
    edge = rows[:-1][(rows[:-1] < rows[1:])]
    line[edge] = False  # a line break that starts or ends a row isn't alone between two characters
    line[edge[1:] - 1] = False
    cut |= line
    cut[1:] |= line[:-1]
    last = edge[1:] - 1
    cut[last[buf[last] == 32]] = False  # a space that ends a row has no character of its row after it
    cut[edge] = True
    return np.flatnonzero(cut)
