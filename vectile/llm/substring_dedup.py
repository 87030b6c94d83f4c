"""Passages that occur more than once: a count-min prefilter, then exact grouping of the windows it can't rule out.

Every window is represented by the least hash of the shorter runs inside it (its anchor). Neighbouring windows share
an anchor, so there are about ten times fewer anchors than windows, and equal windows have equal anchors. Count-min
sketches of the anchors' places are made per task, merged by block, and overestimate the count of every window: a
window whose estimate is below two occurs once. The others are grouped exactly, by a 96-bit fingerprint of their
words. Each task sends a window once; a passage in a third of all documents is settled where it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.llm.blobs import blob_rows, by_bucket, pack, parts_for, text_bytes, unpack

DEPTH = 2  # sketch rows
BLOCK_BITS = 20
MAX_BITS = 29  # a merged sketch row has at most 2**29 bits; the broadcast is DEPTH * 64 MB at most
PIECE_BYTES = 2 << 20
FLUSH = 800_000  # values a task gathers before it hands them on
GROUP_BYTES = 8 << 20

_SKETCH = pa.schema([("block", pa.int32()), ("cells", pa.binary())])
_PLANE = pa.schema([("block", pa.int32()), ("plane", pa.binary())])
_FOUND = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_KNOWN = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 35) -> DataFrame:
    """(id, n_words, n_removed, text): the words left when every window that occurs twice is taken out.

    Words are runs of characters other than space and \\x09-\\x0D. All windows of ``window`` consecutive words are
    judged on the input; a word covered by any window whose word sequence starts at another place too, in the same
    or another row, is removed. ``text``: the words left, joined by one space. A null, empty or shorter text has
    no window and keeps all its words (none for null: an empty ``text``). Equal rows count as separate places.
    Null ids are kept; other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), text).alias("key"), text.alias("text"))
    total = text_bytes(rows, "text")
    anchor = max(1, window * 16 // 35)
    span = window - anchor + 1
    expected = 2 * (total // 6) // (span + 1) + 1
    bits = min(MAX_BITS, max(BLOCK_BITS, (8 * expected).bit_length()))
    planes = spark.sparkContext.broadcast(_sketch(rows, window, anchor, span, bits))
    n = parts_for(spark, total // 6 * 16, GROUP_BYTES)
    k = parts_for(spark, total, GROUP_BYTES)
    found = rows.select("key", "text").mapInArrow(_find(window, anchor, span, bits, planes, n, k), "kind int, bucket int, blob binary")
    known = found.repartition(n, "kind", "bucket").mapInArrow(_settle(k), "bucket int, blob binary")
    keyed = rows.withColumn("bucket", F.pmod("key", F.lit(k)).cast("int"))
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, n_words bigint, n_removed bigint, text string"
    out = keyed.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_strip(window), schema)
    return out.withColumnRenamed("id", id_col)


def _anchors(w: W.Words, h: np.ndarray, window: int, anchor: int, span: int):
    """(hash of each run, anchor of each window, is the window within a row)"""
    ok = W.inside(w.first, window)
    runs = W.rolling(h, anchor)
    return runs, W.slide(runs, span, np.minimum) if len(ok) else runs[:0], ok


def _cells(anchor: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (W.mix(anchor + np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.uint32)


def _sketch(rows: DataFrame, window: int, anchor: int, span: int, bits: int) -> np.ndarray:
    """Merged planes, one a row: a bit for each cell that counts two places or more."""

    def count(batches):
        held, size = [], 0
        for batch in batches:
            for part in W.pieces(batch, "text", PIECE_BYTES):
                w = W.words_of(part.column("text"))
                runs, least, ok = _anchors(w, W.word_hashes(w), window, anchor, span)
                if not len(ok):
                    continue
                pad = np.zeros(span - 1, dtype=np.uint64)
                top = W.slide(np.concatenate([pad, np.where(ok, least, np.uint64(0)), pad]), span, np.maximum)
                held.append(runs[runs == top])
                size += len(held[-1])
                if size > FLUSH:
                    yield _counted(held, bits)
                    held, size = [], 0
        if held:
            yield _counted(held, bits)

    def merge(batches):
        once, twice = {}, {}
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                one, two = unpack(blob, np.uint32, np.uint32)
                if block not in once:
                    once[block] = np.zeros(1 << BLOCK_BITS, dtype=bool)
                    twice[block] = np.zeros(1 << BLOCK_BITS, dtype=bool)
                twice[block][one[once[block][one]]] = True
                twice[block][two] = True
                once[block][one] = True
                once[block][two] = True
        for block in once:
            yield blob_rows([(block, np.packbits(twice[block], bitorder="little").tobytes())], _PLANE)

    n = min(DEPTH << (bits - BLOCK_BITS), 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    merged = rows.select("text").mapInArrow(count, "block int, cells binary").repartition(n, "block")
    out = np.zeros((DEPTH << (bits - BLOCK_BITS), 1 << (BLOCK_BITS - 3)), dtype=np.uint8)
    for block, plane in merged.mapInArrow(merge, "block int, plane binary").toLocalIterator():  # DEPTH * 2**bits bits
        out[block] = np.frombuffer(plane, np.uint8)
    return out.reshape(DEPTH, -1)


def _counted(held: list[np.ndarray], bits: int) -> pa.RecordBatch:
    anchors = np.concatenate(held)
    rows = []
    for row in range(DEPTH):
        cells, n = np.unique(_cells(anchors, row, bits), return_counts=True)
        block = (cells >> np.uint32(BLOCK_BITS)).astype(np.int64) + (row << (bits - BLOCK_BITS))
        low = cells & np.uint32((1 << BLOCK_BITS) - 1)
        for b, at in by_bucket(block):
            many = n[at] > 1
            rows.append((b, pack(low[at][~many], low[at][many])))
    return blob_rows(rows, _SKETCH)


def _find(window: int, anchor: int, span: int, bits: int, planes, n: int, k: int):
    """Windows with an estimate of two or more; those repeated within what the task gathers are settled at once."""

    def find(batches):
        held, size = [], 0
        for batch in batches:
            for part in W.pieces(batch, "text", PIECE_BYTES):
                w = W.words_of(part.column("text"))
                h = W.word_hashes(w)
                _, least, ok = _anchors(w, h, window, anchor, span)
                at = np.flatnonzero(ok)
                for row in range(DEPTH):
                    cell = _cells(least[at], row, bits)
                    at = at[(planes.value[row][cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8)) & 1 == 1]
                if not len(at):
                    continue
                owner = w.row_of()[at]
                key = part.column("key").to_numpy(zero_copy_only=False)[owner]
                other = W.rolling(W.word_hashes(w, 1), window, 1)[at] >> np.uint64(32)
                held.append((W.rolling(h, window)[at], other.astype(np.uint32), key, (at - w.first[owner]).astype(np.uint32)))
                size += len(at)
                if size > FLUSH:
                    yield from _sent(held, n, k)
                    held, size = [], 0
        if held:
            yield from _sent(held, n, k)

    return find


def _sent(held: list, n: int, k: int):
    one, two, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((two, one))
    one, two, key, at = one[order], two[order], key[order], at[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    head = np.flatnonzero(new)
    many = np.diff(np.append(head, len(one))) > 1
    settled = np.repeat(many, np.diff(np.append(head, len(one))))
    rows = [(1, b, blob) for b, blob in _places(key[settled], at[settled], k)]
    for b, p in by_bucket((one[head] % np.uint64(n)).astype(np.int64)):
        h = head[p]
        alone = h[~many[p]]
        rows.append((0, b, pack(one[h[many[p]]], two[h[many[p]]], one[alone], two[alone], key[alone], at[alone])))
    for s in range(0, len(rows), 256):
        yield blob_rows(rows[s : s + 256], _FOUND)


def _places(key: np.ndarray, at: np.ndarray, k: int):
    """(bucket, packed places) by key."""
    for b, p in by_bucket(key % k):
        p = p[np.lexsort((at[p], key[p]))]
        keys, counts = np.unique(key[p], return_counts=True)
        yield b, pack(keys, counts.astype(np.uint32), at[p])


def _settle(k: int):
    """Of the windows that tasks sent, which were sent more than once."""

    def settle(batches):
        sent = []
        for batch in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind:
                    yield blob_rows([(bucket, blob)], _KNOWN)
                else:
                    sent.append(unpack(blob, np.uint64, np.uint32, np.uint64, np.uint32, np.int64, np.uint32))
        if not sent:
            return
        m1, m2, a1, a2, key, at = (np.concatenate(x) for x in zip(*sent, strict=True))
        one, two = np.concatenate([a1, m1]), np.concatenate([a2, m2])
        order = np.lexsort((two, one))
        same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
        many = np.zeros(len(one), dtype=bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        many = many[: len(a1)]
        rows = list(_places(key[many], at[many], k))
        for s in range(0, len(rows), 256):
            yield blob_rows(rows[s : s + 256], _KNOWN)

    return settle


def _strip(window: int):
    def strip(docs: pa.Table, known: pa.Table) -> pa.Table:
        places = [unpack(b, np.int64, np.uint32, np.uint32) for b in known.column("blob").to_pylist()]
        key = np.concatenate([np.repeat(x[0], x[1]) for x in places]) if places else np.zeros(0, np.int64)
        at = np.concatenate([x[2] for x in places]).astype(np.int64) if places else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        n_words, n_removed, texts, ids = [], [], [], []
        for batch in docs.combine_chunks().to_batches():
            for part in W.pieces(batch, "text", PIECE_BYTES):
                w = W.words_of(part.column("text"))
                own = part.column("key").to_numpy(zero_copy_only=False)
                lo, hi = np.searchsorted(key, own, "left"), np.searchsorted(key, own, "right")
                begin = at[W.ranges(lo, hi - lo)] + np.repeat(w.first[:-1], hi - lo)
                cover = np.zeros(len(w.start) + window + 1, dtype=np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + window, -1)
                gone = np.cumsum(cover)[: len(w.start)] > 0
                texts.append(_joined(w, ~gone))
                removed = np.concatenate([[0], np.cumsum(gone)])
                n_removed.append(removed[w.first[1:]] - removed[w.first[:-1]])
                n_words.append(w.counts)
                ids.append(part.column("id"))
        whole = lambda xs: pa.array(np.concatenate(xs) if xs else np.zeros(0, np.int64), pa.int64())
        id_col = pa.chunked_array(ids, type=docs.schema.field("id").type)
        return pa.table({"id": id_col, "n_words": whole(n_words), "n_removed": whole(n_removed), "text": pa.chunked_array(texts, pa.string())})

    return strip


def _joined(w: W.Words, keep: np.ndarray) -> pa.Array:
    """Each row's kept words with one space between."""
    rows = len(w.rows) - 1
    at = np.flatnonzero(keep)
    start, size = w.start[at], (w.end - w.start)[at]
    owner = w.row_of()[at]
    first = np.ones(len(at), dtype=bool)
    first[1:] = owner[1:] != owner[:-1]
    step = size + ~first  # a space before every word but a row's first
    ends = np.cumsum(step)
    out = np.full(int(ends[-1]) if len(at) else 0, 32, dtype=np.uint8)
    out[W.ranges(ends - size, size)] = w.buf[W.ranges(start, size)]
    per = np.bincount(owner, weights=step, minlength=rows).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes()))
