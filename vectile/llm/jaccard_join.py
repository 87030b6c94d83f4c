"""Texts linked by the Jaccard similarity of their word n-grams: an exact metric-space join around pivots.

Random texts all lie at distance one from each other, so pivots say nothing about them. Spaces in which pivots do tell
texts apart are found first, in two ways, and cut by one another. The n-grams are dealt to so many parts that two texts
near enough agree on one part entirely. And put all n-grams in one order, the seldom ones first: two texts near enough share one of
the first few n-grams of either. Texts that share such a key, directly or over others, form a space. In a space, pivots take
the texts within the radius as their balls. By the triangle inequality a member of a ball can have partners outside it only if
it is at least as far out as the nearest outsider less the radius; the other members are done. Large spaces are split
by Spark: texts go to the Voronoi region of their nearest pivot, and boundary texts, no more than twice the radius
farther from another pivot, to that region too. Regions are split again until one task can hold them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectile.llm import words as W
from vectile.llm.blobs import blob_rows, by_bucket, pack, parts_for, text_bytes, unpack
from vectile.llm.joins import attached
from vectile.operators.graph import connected_components, forest
from vectile.session import cut

GROW = 1.5  # sizes up to this factor share a way of dealing n-grams to parts
CELLS = 24  # the table of common n-grams, sent to every task, has 2**24 bytes
FLUSH = 500_000
SEND_ROWS = 1_000_000
GROUP_BYTES = 8 << 20
REGION = 2_000  # texts of a region that one task joins, and their n-grams
REGION_GRAMS = 4_000_000
PIVOTS = 16
SLACK = 1e-9

_SET = "id {id}, key bigint, n bigint, class bigint"
_EDGE = pa.schema([("i", pa.int64()), ("j", pa.int64())])
_SENT = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_POINT = pa.schema([("region", pa.int64()), ("class", pa.int64()), ("grams", pa.binary())])


def gram_sets(col, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct n-grams of each row, sorted; a text shorter than ``size`` words is one n-gram."""
    w = W.words_of(col, lower=True)
    h, count = W.word_hashes(w), w.counts
    ok = np.flatnonzero(W.inside(w.first, size))
    who = w.row_of()
    short = np.flatnonzero((count > 0) & (count < size))
    extra = np.zeros(len(short), dtype=np.uint64)
    for k in range(size - 1):
        has = count[short] > k
        extra[has] = W.mix(extra[has] * np.uint64(31) + h[w.first[short[has]] + k] + np.uint64(k + 1))
    row = np.concatenate([who[ok], short])
    gram = np.concatenate([W.rolling(h, size)[ok], extra])
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])
    return row[new], gram[new]


def _classes(row: np.ndarray, gram: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, 63-bit name) of each row's set; equal sets have equal names, and sets of one name count as equal. That
    any two of a billion different sets share a name has a chance of 5 %."""
    n = np.bincount(row, minlength=rows)
    total = np.zeros(len(gram) + 1, dtype=np.uint64)
    np.cumsum(W.mix(gram), out=total[1:])
    cuts = np.concatenate([[0], np.cumsum(n)])
    name = W.mix(total[cuts[1:]] - total[cuts[:-1]] + W.mix(n.astype(np.uint64)))
    return n, (name >> np.uint64(1)).astype(np.int64)


def _scheme(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(GROW) + 1e-9).astype(np.int64)


def _bounds(scheme: int) -> tuple[int, int]:
    """Least and greatest size of a scheme."""
    lo = int(np.ceil(GROW**scheme - 1e-6))
    while _scheme(np.array([lo]))[0] < scheme:
        lo += 1
    hi = int(GROW ** (scheme + 1)) + 2
    while _scheme(np.array([hi]))[0] > scheme:
        hi -= 1
    return lo, hi


def jaccard_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90,
) -> DataFrame:
    """(id, n_shingles, component_id) of every row.

    A row's set: distinct runs of ``size`` words, A-Z lowered; with fewer words the whole sequence as one; null or
    wordless texts have none. Rows link when 100 * common >= ``percent`` * united; ``component_id`` is the least id
    reachable over links, the row's own for an empty set. Equal rows and equal sets are one point of the join. A null
    id is never the least, unless alone. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("text"))
    spark, total = docs.sparkSession, text_bytes(rows, "text")
    sets = cut(rows.mapInArrow(_describe(size), _SET.format(id=rows.schema["id"].dataType.simpleString())))
    level = spark.sparkContext.broadcast(_common_grams(rows, size))
    spaces = None
    for keys in (lambda *x: _signatures(*x, percent), lambda *x: [first_grams(*x, percent, level.value)]):
        space = connected_components(cut(_candidates(rows, total, size, keys))).select(F.col("id").alias("class"), "component")
        # near sets are in one space either way, so spaces are cut by one another
        spaces = space.withColumnRenamed("component", "region") if spaces is None else spaces.join(space, "class").select("class", F.xxhash64("region", "component").alias("region"))
    spaces = cut(spaces)
    alone = spaces.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region")
    spaces = cut(spaces.join(alone.hint("merge"), "region", "left_semi"))
    first = cut(sets.where("n > 0").groupBy("class").agg(F.min("key").alias("key")).join(spaces, "class").select("key", "class", "region"))
    points = rows.select("key", "text").join(sent(first), "key").select("class", "region", "text").mapInArrow(_points(size), "region bigint, class bigint, grams binary")
    links = _join(cut(points), percent)
    joined = connected_components(links).select(F.col("id").alias("class"), F.col("component").alias("root"))
    own = sets.where("n > 0").groupBy("class").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    named = own.join(joined, "class", "left").withColumn("root", F.coalesce("root", "class"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(attached(named, lowest, "root").select("class", "component_id"))
    full = attached(sets.where("n > 0"), named, "class")
    out = full.select("id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        sets.where("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    )
    return out.withColumnRenamed("id", id_col)


def sent(table: DataFrame) -> DataFrame:
    """A written table of few columns: to every task up to SEND_ROWS rows, counted first, so that the texts stay where they are."""
    return F.broadcast(table) if table.count() <= SEND_ROWS else table.hint("merge")


def _describe(size: int):
    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                n, name = _classes(*gram_sets(part.column("text"), size), part.num_rows)
                yield pa.RecordBatch.from_pydict({"id": part.column("id"), "key": part.column("key"), "n": pa.array(n, pa.int64()), "class": pa.array(name, pa.int64())})

    return run


def _cells(gram: np.ndarray) -> np.ndarray:
    return (W.mix(gram + np.uint64(3)) >> np.uint64(64 - CELLS)).astype(np.uint32)


def _common_grams(rows: DataFrame, size: int) -> np.ndarray:
    """For each cell of n-grams the logarithm of how often it was met again within what one task had at hand.

    It only puts the n-grams in an order, so it need not be exact. Whatever stands in more than about the root of the
    number of such portions is met again somewhere. The table's size is fixed.
    """

    def again(held: list) -> pa.RecordBatch:
        cells, n = np.unique(np.concatenate(held), return_counts=True)
        cells, n = cells[n > 1], n[n > 1]
        return blob_rows([(b, pack(cells[p], n[p].astype(np.uint32))) for b, p in by_bucket((cells >> np.uint32(CELLS - 6)).astype(np.int64))], _SENT)

    def count(batches):
        held, many = [], 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                held.append(_cells(gram_sets(part.column("text"), size)[1]))
                many += len(held[-1])
                if many > 4 * FLUSH:
                    yield again(held)
                    held, many = [], 0
        if held:
            yield again(held)

    def merge(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                cells, n = unpack(blob, np.uint32, np.uint32)
                whole = total.setdefault(bucket, np.zeros(1 << (CELLS - 6), dtype=np.int64))
                whole[cells & np.uint32((1 << (CELLS - 6)) - 1)] += n
        for bucket, n in total.items():
            level = np.ceil(np.log2(np.maximum(n, 1)) * 4).astype(np.uint8)
            yield blob_rows([(bucket, level.tobytes())], _SENT)

    out = np.zeros(1 << CELLS, dtype=np.uint8)
    kept = rows.select("text").mapInArrow(count, "bucket int, blob binary").repartition(64, "bucket").mapInArrow(merge, "bucket int, blob binary")
    for bucket, blob in kept.toLocalIterator():  # 2**CELLS bytes in all
        out[bucket << (CELLS - 6) : (bucket + 1) << (CELLS - 6)] = np.frombuffer(blob, np.uint8)
    return out


def _candidates(rows: DataFrame, total: int, size: int, keys: Callable) -> DataFrame:
    """(i, j): classes that share one of ``keys``. All classes of a key hang together over their least."""
    n = parts_for(rows.sparkSession, total // 4, GROUP_BYTES)

    def deal(batches):
        held, held_n = [], 0
        for batch in batches:
            for part in W.pieces(batch, "text"):
                row, gram = gram_sets(part.column("text"), size)
                count, name = _classes(row, gram, part.num_rows)
                new = keys(row, gram, count, name)
                held += new
                held_n += sum(len(x[0]) for x in new)
                if held_n > FLUSH:
                    yield from _flushed(held, n)
                    held, held_n = [], 0
        if held:
            yield from _flushed(held, n)

    return rows.select("text").mapInArrow(deal, "bucket int, blob binary").repartition(n, "bucket").mapInArrow(_meet, "i bigint, j bigint")


def _meet(batches):
    """Links that hang the classes of each signature together."""
    sent = [unpack(b, np.uint64, np.int64, np.int64, np.int64) for batch in batches for b in batch.column("blob").to_pylist()]
    if not sent:
        return
    sign, name, i, j = (np.concatenate(x) for x in zip(*sent, strict=True))
    a, b = _stars(sign, name)[:2]
    yield pa.record_batch([pa.array(x) for x in forest(np.concatenate([i, a]), np.concatenate([j, b]))], schema=_EDGE)


def first_grams(row, gram, count, name, percent: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, class) of the first of each set in the order of ``level`` and hash.

    Near sets of sizes n and m share at least percent * max(n, m) / 100 n-grams, so of the first n - that + 1 of one and the
    first of the other, in whatever order all keep to, one is the same.
    """
    order = np.lexsort((W.mix(gram ^ np.uint64(0xA5A5A5A5A5A5A5A5)), level[_cells(gram)], row))
    start = np.cumsum(count) - count
    many = np.where(count > 0, count - -(-count * percent // 100) + 1, 0)
    return gram[order][W.ranges(start, many)], np.repeat(name, many)


def _signatures(row, gram, count, name, percent) -> list[tuple[np.ndarray, np.ndarray]]:
    """(signature, class) of every part of every set, in its scheme and, for sizes near the top, in the next.

    With sizes up to ``hi``, near sets differ in at most d = 2 hi (100 - p) / (100 + p) n-grams; on more than d parts
    that aren't empty, one has no difference. The few sets with fewer filled parts also share a signature.
    """
    out = []
    start = np.concatenate([[0], np.cumsum(count)])
    own = _scheme(count)
    for scheme in np.unique(own[count > 0]):
        for t in (scheme, scheme + 1):
            lo, hi = _bounds(int(t))
            differ = 2 * hi * (100 - percent) // (100 + percent)
            which = np.flatnonzero((own == scheme) & (count > 0) & (100 * count >= percent * lo))
            if not differ or not len(which):
                continue  # so small that only equal sets are near
            parts = differ + 3
            at = W.ranges(start[which], count[which])
            who = np.repeat(np.arange(len(which)), count[which])
            g = gram[at]
            slot = who * parts + (W.mix(g + np.uint64(0x51ED27)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(slot, kind="stable")
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(g[order] ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64)])
            filled, first, many = np.unique(slot[order], return_index=True, return_counts=True)
            salt = ((filled % parts) + (int(t) << 32)).astype(np.uint64)
            out.append((W.mix(total[first + many] - total[first] + W.mix(salt)), name[which][filled // parts]))
            few = np.flatnonzero(np.bincount(filled // parts, minlength=len(which)) <= differ)
            if len(few):
                out.append((np.full(len(few), W.mix(np.array([(int(t) << 32) + (1 << 31)], dtype=np.uint64))[0]), name[which][few]))
    return out


def _stars(sign: np.ndarray, name: np.ndarray):
    """(class, least class of its signature) where they differ; each signature with its least class."""
    order = np.lexsort((name, sign))
    sign, name = sign[order], name[order]
    new = np.ones(len(sign), dtype=bool)
    new[1:] = sign[1:] != sign[:-1]
    head = np.flatnonzero(new)
    least = name[head][np.cumsum(new) - 1]
    apart = name != least
    return name[apart], least[apart], sign[head], name[head]


def _flushed(held: list, n: int):
    """Signatures of a flush under the least class that theirs hangs together with, and each class with that one."""
    sign, name = (np.concatenate(x) for x in zip(*held, strict=True))
    i, j, sign, name = _stars(sign, name)
    i, j = forest(i, j)
    at = np.searchsorted(i, name)
    known = at < len(i)
    known[known] = i[at[known]] == name[known]
    name = np.where(known, j[np.minimum(at, max(0, len(j) - 1))], name) if len(i) else name
    pair = np.stack([i, j])
    rows = []
    to = dict(by_bucket(((pair[0].view(np.uint64) ^ pair[1].view(np.uint64)) % np.uint64(n)).astype(np.int64)))
    none = np.zeros(0, dtype=np.int64)
    for b, p in by_bucket((sign % np.uint64(n)).astype(np.int64)):
        e = to.pop(b, none)
        rows.append((b, pack(sign[p], name[p], pair[0][e], pair[1][e])))
    for b, e in to.items():
        rows.append((b, pack(sign[:0], name[:0], pair[0][e], pair[1][e])))
    for s in range(0, len(rows), 256):
        yield blob_rows(rows[s : s + 256], _SENT)


def _points(size: int):
    def run(batches):
        for batch in batches:
            for part in W.pieces(batch, "text"):
                row, gram = gram_sets(part.column("text"), size)
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                blobs = [gram[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([part.column("region"), part.column("class"), pa.array(blobs, pa.binary())], schema=_POINT)

    return run


def _join(points: DataFrame, percent: int) -> DataFrame:
    """(i, j): links that connect what is connected, from regions split until a task can hold them."""
    out, points = None, _apart(points, percent)
    while True:
        sizes = cut(points.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(_grams()).alias("grams_n")))
        big = sizes.where((F.col("n") > 1) & (_tasks() > 1)).withColumn("salts", _tasks())
        many = big.count()
        small = points.join(big.select("region"), "region", "left_anti") if many else points
        found = cut(small.groupBy("region").applyInArrow(_joined(percent), "i bigint, j bigint"))
        out = found if out is None else out.unionByName(found)
        if not many:
            return out
        links, stuck, points = _split(points, cut(_measured(points, big)), big, percent)
        out = out.unionByName(links).unionByName(cut(_tiled(stuck, percent)))


def _apart(points: DataFrame, percent: int) -> DataFrame:
    """Points, with large regions cut to what shares one of its first n-grams, the seldom ones of the region first.

    Here the n-grams of a region are counted together, so that no text is held by one that it has to itself. They are counted
    by hashes, equal for equal n-grams: the order stays one that all texts keep to. Each class is in one region.
    """
    sizes = points.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(_grams()).alias("grams_n"))
    big = cut(sizes.where((F.col("n") > 1) & (_tasks() > 1)).select("region", "grams_n"))
    total = big.agg(F.sum("grams_n")).first()[0]
    if not total:
        return points
    n = parts_for(points.sparkSession, int(total) * 6, GROUP_BYTES)
    large = points.join(big.select("region"), "region", "left_semi").select("region", "class", "grams")
    kind, blobs = "bucket int, blob binary", lambda rows: (blob_rows(rows[s : s + 256], _SENT) for s in range(0, len(rows), 256))

    def deal(batches):
        for batch in batches:
            count = np.array([len(x) // 8 for x in batch.column("grams").to_pylist()], dtype=np.int64)
            piece = (np.cumsum(count) // FLUSH) + np.arange(len(count)) // (1 << 15)
            for _, rows in by_bucket(piece):
                part = batch.slice(int(rows[0]), len(rows))
                size, flat, _ = _flat_sets(part.column("grams"))
                who = np.repeat(np.arange(len(size)), size)
                region, name = (part.column(c).to_numpy() for c in ("region", "class"))
                gram = W.mix(flat ^ W.mix(region.astype(np.uint64))[who])
                out = []
                for b, p in by_bucket(((gram >> np.uint64(32)) % np.uint64(n)).astype(np.int64)):
                    mine, place = np.unique(who[p], return_inverse=True)
                    out.append((b, pack(gram[p].astype(np.uint32), place.astype(np.uint16), name[mine], size[mine])))
                yield from blobs(out)

    def count(batches):
        """Each class with its n-grams that others have too, and in how many sets they are."""
        met: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                low, place, name, size = unpack(blob, np.uint32, np.uint16, np.int64, np.int64)
                met.setdefault(b, []).append((low, name[place], size[place]))
        for b, held in met.items():
            low, name, size = (np.concatenate(x) for x in zip(*held, strict=True))
            _, back, many = np.unique(low, return_inverse=True, return_counts=True)
            again = many[back] > 1
            gram, name, size, many = (np.uint64(b) << np.uint64(32)) | low[again].astype(np.uint64), name[again], size[again], many[back][again]
            to = (name.view(np.uint64) % np.uint64(n)).astype(np.int64)
            yield from blobs([(t, pack(gram[p], name[p], size[p], many[p])) for t, p in by_bucket(to)])

    def choose(batches):
        held = [unpack(b, np.uint64, np.int64, np.int64, np.int64) for batch in batches for b in batch.column("blob").to_pylist()]
        if not held:
            return
        gram, name, size, many = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((gram, many, name))
        gram, name, size = gram[order], name[order], size[order]
        _, first, shared = np.unique(name, return_index=True, return_counts=True)
        # its own n-grams come first in each set
        left = size[first] - -(-size[first] * percent // 100) + 1 - (size[first] - shared)
        kept = W.ranges(first, np.clip(left, 0, shared))
        if len(kept):
            yield from _flushed([(gram[kept], name[kept])], n)

    each = large.mapInArrow(deal, kind).repartition(n, "bucket").mapInArrow(count, kind).repartition(n, "bucket").mapInArrow(choose, kind)
    links = cut(each.repartition(n, "bucket").mapInArrow(_meet, "i bigint, j bigint"))
    spaces = cut(connected_components(links).select(F.col("id").alias("class"), "component"))
    near = large.join(sent(spaces), "class").select(F.xxhash64("region", "component").alias("region"), "class", "grams")
    rest = points.join(big.select("region"), "region", "left_anti").select("region", "class", "grams")
    return rest.unionByName(cut(near))


def _grams() -> Column:
    return F.octet_length("grams") / 8


def _tasks() -> Column:
    """How many tasks a region's n texts with grams_n n-grams are worth."""
    return F.ceil(F.greatest(F.col("n") / REGION, F.col("grams_n") / REGION_GRAMS)).cast("int")


def _measured(points: DataFrame, big: DataFrame) -> DataFrame:
    """(region, class, pivots, common, united): large regions' texts and their pivots, drawn by a hash of the class."""
    large = points.join(big, "region")
    chance = F.pmod(F.xxhash64("class", "region"), F.lit(1 << 30)) / float(1 << 30)
    drawn = large.where(chance < 4.0 * PIVOTS / F.col("n"))
    order = Window.partitionBy("region").orderBy("c", "class")
    pivots = drawn.withColumn("c", chance).withColumn("k", F.row_number().over(order)).where(F.col("k") <= PIVOTS)
    pivots = cut(pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "k", "class", "grams"))
    dealt = large.withColumn("salt", F.pmod(F.xxhash64("class"), "salts").cast("int")).select("region", "salt", "class", "grams")

    def measure(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        order = np.argsort(theirs.column("k").to_numpy())
        names = theirs.column("class").to_numpy()[order]
        sets = [np.frombuffer(theirs.column("grams")[int(o)].as_py(), np.uint64) for o in order]
        n, flat, _ = _flat_sets(mine.column("grams"))
        common = np.stack([_common(flat, n, s) for s in sets], axis=1) if sets else np.zeros((len(n), 0), np.int64)
        united = n[:, None] + np.array([len(s) for s in sets])[None, :] - common
        lists = lambda x, t: pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * len(sets), pa.int32()), pa.array(x.ravel(), t))
        whole = np.broadcast_to(names, (len(n), len(names)))
        return pa.table({
            "region": mine.column("region"), "class": mine.column("class"), "pivots": lists(np.ascontiguousarray(whole), pa.int64()),
            "common": lists(common, pa.int64()), "united": lists(united, pa.int64()),
        })

    return dealt.groupBy("region", "salt").cogroup(pivots.groupBy("region", "salt")).applyInArrow(
        measure, "region bigint, class bigint, pivots array<bigint>, common array<bigint>, united array<bigint>"
    )


def _split(points: DataFrame, measured: DataFrame, big: DataFrame, percent: int):
    """(links to pivots, regions that pivots don't part, the regions that they do)."""
    radius = 1 - percent / 100
    balls = F.arrays_zip("pivots", "common", "united")
    held = lambda x: x["common"] * 100 >= x["united"] * percent
    d = lambda x: 1 - x["common"] / x["united"]
    # a text links to the first pivot whose ball holds it, and that pivot to the others, once each
    near = measured.select("region", "class", F.transform(F.filter(balls, held), lambda x: x["pivots"]).alias("near")).where(F.size("near") > 0)
    first = near.where(F.get("near", F.lit(0)) != F.col("class")).select(F.col("class").alias("i"), F.get("near", F.lit(0)).alias("j"))
    among = near.where(F.size("near") > 1).select("near").distinct().select(F.get("near", F.lit(0)).alias("i"), F.explode(F.slice("near", F.lit(2), F.size("near"))).alias("j")).distinct()
    links = cut(first.unionByName(among))
    each = measured.select("region", F.explode(F.filter(balls, lambda x: ~held(x))).alias("x")).select("region", "x.*")
    nearest = each.groupBy("region", "pivots").agg(F.min(1 - F.col("common") / F.col("united")).alias("edge"))  # the nearest outsider of each ball
    edges = nearest.groupBy("region").agg(F.map_from_entries(F.collect_list(F.struct("pivots", "edge"))).alias("edges"))  # PIVOTS at most
    lonely = F.create_map().cast("map<bigint,double>")
    known = measured.join(edges, "region", "left").withColumn("edges", F.coalesce("edges", lonely))
    done = F.exists(balls, lambda x: held(x) & (d(x) < F.coalesce(F.element_at("edges", x["pivots"]), F.lit(2.0)) - radius - SLACK))
    close = F.array_min(F.transform(balls, d))
    homes = F.transform(F.filter(balls, lambda x: d(x) <= close + 2 * radius + SLACK), lambda x: x["pivots"])
    left = cut(known.where(~done).select("region", "class", homes.alias("homes")))
    moved = left.select("region", "class", F.explode("homes").alias("pivot")).select("region", "class", F.xxhash64("region", "pivot").alias("child"))
    sizes = moved.groupBy("region", "child").agg(F.count(F.lit(1)).alias("m")).join(big, "region")
    # a region whose children are hardly smaller is joined by tiles instead
    stuck = cut(sizes.groupBy("region").agg(F.max(F.col("m") > 0.7 * F.col("n")).alias("stuck")).where("stuck").select("region"))
    parted = moved.join(stuck, "region", "left_anti")
    parted = points.join(parted.hint("merge"), ["region", "class"]).select(F.col("child").alias("region"), "class", "grams")
    rest = left.join(stuck, "region", "left_semi").select("region", "class")
    return links, points.join(rest.hint("merge"), ["region", "class"]), cut(parted)


def _tiled(points: DataFrame, percent: int) -> DataFrame:
    """Every two tiles of a region in one task. Near sets differ in size by the radius at most, so tiles are cut within
    bands of sizes, and meet those of their own band and of the next ones."""
    grow = math.log(100 / percent) + SLACK if percent < 100 else SLACK
    own = points.withColumn("band", F.floor(F.log(_grams()) / grow)) if percent < 100 else points.withColumn("band", _grams().cast("bigint"))
    sizes = own.groupBy("region", "band").agg(F.count(F.lit(1)).alias("n"), F.sum(_grams()).alias("grams_n"))
    sizes = cut(sizes.select("region", "band", F.ceil(2 * F.greatest(F.col("n") / REGION, F.col("grams_n") / REGION_GRAMS)).cast("int").alias("tiles")))
    own = own.join(sizes, ["region", "band"]).withColumn("tile", F.pmod(F.xxhash64("class", F.lit(9)), F.col("tiles")).cast("int"))
    # which bands a band meets, each with the tiles there
    step = sizes.select("region", "tiles", F.col("band").alias("with"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
    met = own.drop("tiles").join(step.hint("merge"), ["region", "band"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    here, there = F.struct(F.col("band").alias("band"), F.col("tile").alias("tile")), F.struct(F.col("with").alias("band"), F.col("other").alias("tile"))
    met = met.select(F.xxhash64("region", F.least(here, there), F.greatest(here, there)).alias("pair"), "class", "grams")
    return met.select(F.col("pair").alias("region"), "class", "grams").groupBy("region").applyInArrow(_joined(percent), "i bigint, j bigint")


def _flat_sets(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sizes, all n-grams one row after the other, starts)"""
    blobs = col.to_pylist()
    n = np.array([len(b) // 8 for b in blobs], dtype=np.int64)
    return n, np.frombuffer(b"".join(blobs), np.uint64), np.cumsum(n) - n


def _common(flat: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """How many of each set's n-grams are in ``other``, a sorted set."""
    at = np.minimum(np.searchsorted(other, flat), len(other) - 1)
    total = np.concatenate([[0], np.cumsum(other[at] == flat)])
    ends = np.cumsum(n)
    return total[ends] - total[ends - n]


def _joined(percent: int):
    """Links of a region held in one task, as (class, an earlier class of its component)."""

    def run(table: pa.Table) -> pa.Table:
        names = table.column("class").to_numpy()
        names, keep = np.unique(names, return_index=True)
        n, flat, start = _flat_sets(table.column("grams").take(pa.array(keep)))
        i, j = component_links(n, flat, start, percent)
        return pa.table({"i": names[i], "j": names[j]}, schema=_EDGE)

    return run


def component_links(n: np.ndarray, flat: np.ndarray, start: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect exactly what all links would connect, ball by ball.

    The pivot is the set whose n-grams are the most common. Its ball links to it. A set outside is compared with
    members far enough out, unless it hangs together with the ball already; then the rest goes on without the ball.
    """
    radius = 1 - percent / 100
    _, flat = np.unique(flat, return_inverse=True)
    width = int(flat.max()) + 1 if len(flat) else 0
    boss = np.arange(len(n))
    out: list[tuple[int, int]] = []

    def root(x: int) -> int:
        while boss[x] != x:
            boss[x] = boss[boss[x]]
            x = boss[x]
        return int(x)

    def link(a: int, b: int) -> None:
        out.append((a, b))
        x, y = root(a), root(b)
        boss[max(x, y)] = min(x, y)

    def measure(p: int, among: np.ndarray) -> np.ndarray:
        mark = np.zeros(width, dtype=bool)
        mark[flat[start[p] : start[p] + n[p]]] = True
        hit = mark[flat[W.ranges(start[among], n[among])]]
        total = np.concatenate([[0], np.cumsum(hit)])
        ends = np.cumsum(n[among])
        return total[ends] - total[ends - n[among]]

    held = np.bincount(flat, minlength=width)  # in how many sets each n-gram is, and in which
    at = np.cumsum(held) - held
    owner = np.repeat(np.arange(len(n)), n)[np.argsort(flat, kind="stable")] if len(flat) else np.zeros(0, np.int64)
    total = np.concatenate([[0.0], np.cumsum(held[flat].astype(float))])
    worth = (total[start + n] - total[start]) / np.maximum(n, 1)
    active = np.argsort(-worth, kind="stable")
    while len(active) > 1:
        p, rest = int(active[0]), active[1:]
        own = flat[start[p] : start[p] + n[p]]
        common = np.bincount(owner[W.ranges(at[own], held[own])], minlength=len(n))[rest]
        united = n[p] + n[rest] - common
        near = 100 * common >= percent * united
        away = 1 - common / united
        for x in rest[near]:
            link(p, int(x))
        ball, depth = rest[near], away[near]
        edge = np.flatnonzero(~near & (away <= 2 * radius + SLACK))
        for e in edge:
            x = int(rest[e])
            if root(x) == root(p):
                continue
            reach = ball[depth >= away[e] - radius - SLACK]
            if not len(reach):
                continue
            c = measure(x, reach)
            hit = np.flatnonzero(100 * c >= percent * (n[x] + n[reach] - c))
            if len(hit):
                link(x, int(reach[hit[0]]))
        active = rest[~near]
    pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]
