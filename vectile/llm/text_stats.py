"""Counts over whole texts that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from vectile.llm import words as W

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bars", "n_marks", "n_digits", "n_distinct", "n_top")

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_row(mask: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return total[rows[1:]] - total[rows[:-1]]


def lines_of(w: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the \\n-split lines that hold a word."""
    breaks = np.flatnonzero(w.buf == 10)
    start = np.unique(np.concatenate([w.rows[:-1], breaks + 1]))
    start = start[start < len(w.buf)]
    if not len(start):
        return start, start, start
    nothing = np.zeros(0, dtype=np.int64)
    end = np.append(start[1:], len(w.buf)) if len(start) else nothing
    last = w.buf[end - 1] == 10
    at = np.searchsorted(w.start, start)
    has = (at < len(w.start)) & (w.start[np.minimum(at, len(w.start) - 1)] < end) if len(w.start) else np.zeros(len(start), bool)
    start, end = start[has], (end - last)[has]
    return start, end, np.searchsorted(w.rows, start, side="right") - 1


def counts(col: pa.Array) -> tuple[W.Words, dict[str, np.ndarray]]:
    """The words of a column and, per row, the counts named in COUNTS; all zero for null and empty texts.

    word_chars: characters in words. n_symbols: characters of ``#*$%&|<>``. n_dup_lines: lines with a word equal to
    an earlier line. n_repeat_words: words in 5-word windows found twice or more in the row. n_distinct: different
    words. n_top: occurrences of the most frequent word.
    """
    w = W.words_of(col)
    n, rows = len(w.rows) - 1, w.rows
    out = {"n_words": w.counts.astype(np.int64)}
    lead = (w.buf & 0xC0) != 0x80
    solid = ~W._SPACE[w.buf]
    out["word_chars"] = _per_row(lead & solid, rows)
    out["n_symbols"] = _per_row(_SYMBOL[w.buf], rows)
    out["n_upper"] = _per_row((w.buf >= 65) & (w.buf <= 90), rows)
    out["n_bars"] = _per_row(w.buf == 124, rows)
    out["n_marks"] = _per_row(w.buf == 33, rows)
    out["n_digits"] = _per_row((w.buf >= 48) & (w.buf <= 57), rows)
    start, end, owner = lines_of(w)
    line = W.mix(W.span_hashes(w.buf, start, end) + W.mix(owner.astype(np.uint64)))
    _, first = np.unique(line, return_index=True)
    again = np.ones(len(line), dtype=np.int64)
    again[first] = 0
    out["n_dup_lines"] = np.bincount(owner, weights=again, minlength=n).astype(np.int64)
    out["n_lines"] = np.bincount(owner, minlength=n).astype(np.int64)
    h = W.word_hashes(w)
    ok = np.flatnonzero(W.inside(w.first, 5))
    who = w.row_of()
    runs = W.mix(W.rolling(h, 5)[ok] + W.mix(who[ok].astype(np.uint64)))
    begin = ok[W.repeated(runs)]
    cover = np.zeros(len(h) + 6, dtype=np.int64)
    np.add.at(cover, begin, 1)
    np.add.at(cover, begin + 5, -1)
    out["n_repeat_words"] = np.bincount(who, weights=np.cumsum(cover)[: len(h)] > 0, minlength=n).astype(np.int64)
    _, at, many = np.unique(W.mix(h + W.mix(who.astype(np.uint64))), return_index=True, return_counts=True)
    out["n_distinct"] = np.bincount(who[at], minlength=n).astype(np.int64)
    top = np.zeros(n, dtype=np.int64)
    np.maximum.at(top, who[at], many)
    out["n_top"] = top
    return w, out


def shares(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Length-free statistics of the counts, in 0 .. 1 but for the mean word length."""
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    return {
        "symbol_share": c["n_symbols"] / chars, "bar_share": c["n_bars"] / words, "mark_share": c["n_marks"] / words,
        "upper_share": c["n_upper"] / chars, "digit_share": c["n_digits"] / chars,
        "dup_line_share": c["n_dup_lines"] / np.maximum(c["n_lines"], 1), "repeat_share": c["n_repeat_words"] / words,
        "distinct_share": c["n_distinct"] / words, "top_share": c["n_top"] / words, "mean_word": c["word_chars"] / words,
    }
