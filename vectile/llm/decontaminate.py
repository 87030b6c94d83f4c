"""Benchmark questions in documents, also with other numbers, names and units. DataFrame functions only.

Texts become templates: numbers, capitalised words within a sentence, and units after numbers turn into typed
placeholders; the rest is lowered and freed of punctuation. Windows of eight template words (of all words of a shorter
item) are joined by hash; those with few plain words by the words themselves. What
matches is then checked slot by slot: a value of the question must always stand for the same value of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectile.session import cut

WINDOW = 8
LITERALS = 4  # words that are no placeholders; a benchmark window with fewer is joined literally
ANYWHERE = -(1 << 62)  # in place of a shift: the windows' first places
SEND_ROWS = 2_000_000  # benchmark windows up to this many, counted first, go to every task; more are shuffled
NUM, NAME, UNIT, START = "\ue000", "\ue001", "\ue002", "\ue003"
# Fixed unit words.
UNITS = (
    "mm cm m km in ft yd mi mile miles meter meters metre metres foot feet inch inches g kg mg lb lbs oz gram grams kilogram "
    "kilograms ton tons l ml liter liters litre litres s sec second seconds min minute minutes h hr hour hours day days "
    "week weeks month months year years percent dollar dollars euro euros cent cents pound pounds degree degrees"
).split()

_NUMBER = r"(?<!\S)[(\[\"'$€£+-]*\d[\d.,:/%°()-]*[\"'\]).,;:!?]*(?!\S)"
_NAME = rf"{START}(?<=[^\s.!?:\"]\s{{1,3}}{START})"
_START = r"(?<!\S)[(\[\"']*\p{Lu}\p{L}*(?:['-]\p{L}+)*[\"')\].,;:!?]*(?!\S)"
_UNIT = rf"(?i)(?<={NUM}\s{{1,3}})({NAME}?)(?:{'|'.join(UNITS)})[)\].,;:!?]*(?!\S)"
_SPLIT = r"[\x20\x09-\x0D]+"


def _free(text: Column) -> Column:
    """Without the characters that stand for placeholders."""
    return F.regexp_replace(text, "[\ue000-\ue003]", "a")


def _lowered(text: Column) -> Column:
    """Lowered so that upper case leads to the same."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def originals(text: Column) -> Column:
    """Words with a letter or digit, as written."""
    return _split(F.regexp_replace(_free(text), r"(?<!\S)[^\p{L}\p{N}\x09-\x0D\x20]+(?!\S)", ""))


def marked(text: Column) -> Column:
    """Lowered words without punctuation: numbers replaced, NAME before names within a sentence, START before other
    capitalised words, and UNIT in place of units, also of marked ones."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(_free(text), _NUMBER, NUM), _START, f"{START}$0"), _NAME, NAME)
    return F.regexp_replace(_unpointed(_lowered(F.regexp_replace(t, _UNIT, f"$1{UNIT}"))), r"(?<!\S)\p{M}+(?!\S)", "")


def _unpointed(text: Column) -> Column:
    """Words freed of punctuation, also within them; placeholders stay."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}\p{M}\x09-\x0D\x20\ue000-\ue003]+", "")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(text, _SPLIT), "")


def template(mark: Column) -> Column:
    """One template word of ``marked`` text for each word of ``originals``; names at a sentence start are plain words."""
    return _split(F.translate(F.regexp_replace(mark, rf"{NAME}\S*", NAME), START, ""))


def started(mark: Column) -> Column:
    """As ``template``, with placeholders for all capitalised words, also at a sentence start."""
    return _split(F.regexp_replace(F.translate(F.regexp_replace(mark, rf"{NAME}{UNIT}", UNIT), START, NAME), rf"{NAME}\S*", NAME))


def cased(mark: Column) -> Column:
    """As ``template``, with names as lowered words: the same in every case."""
    return _split(F.translate(mark, NAME + START, ""))


def literal(text: Column) -> Column:
    """The words of ``originals`` lowered, without punctuation around them: values stay."""
    t = F.regexp_replace(_lowered(_free(text)), r"(?<!\S)[^\p{L}\p{N}\x09-\x0D\x20]+|[^\p{L}\p{N}%\x09-\x0D\x20]+(?!\S)", "")
    return _split(t)


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x))


def _window(hashes: Column, at: Column, size) -> Column:
    return F.xxhash64(F.slice(hashes, at + 1, size))


def benchmark_windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", any_case: bool = False) -> DataFrame:
    """(item, at, size, window, literal, typed, n_typed, n_all): windows of every item, of all its words if it has fewer than WINDOW.

    A place has a window in each form that has at least LITERALS plain words there: template, names at sentence starts
    replaced too, and with ``any_case`` names as lowered words. With neither the first nor the last the window is of
    literal words. ``typed`` places have the first form; ``n_typed`` and ``n_all`` count the places of an item.
    """
    text = F.col(text_col).cast("string")
    items = benchmark.select(F.col(item_col).alias("item"), marked(text).alias("m"), literal(text).alias("l")).where("m IS NOT NULL")
    items = items.select("item", "l", template(F.col("m")).alias("t"), started(F.col("m")).alias("s"), cased(F.col("m")).alias("c"))
    items = items.where(F.size("t") > 0).withColumn("size", F.least(F.size("t"), F.lit(WINDOW)))
    items = items.select("*", *[_hashes(F.col(f)).alias(f"h{f}") for f in "tscl"])
    wide = items.select("*", F.explode(F.sequence(F.lit(0), F.size("t") - F.col("size"))).alias("at"))
    plain = lambda f: F.size(F.filter(F.slice(f, F.col("at") + 1, F.col("size")), lambda x: ~x.isin(NUM, NAME, UNIT))) >= LITERALS
    wide = wide.withColumn("typed", plain("t")).withColumn("open", plain("s")).withColumn("low", plain("c") & F.lit(any_case))
    form = lambda ok, f: F.when(ok, F.struct(_window(F.col(f"h{f}"), F.col("at"), F.col("size")).alias("window"), F.lit(f == "l").alias("literal")))
    forms = F.array_compact(F.array(form(F.col("typed"), "t"), form(F.col("open"), "s"), form(F.col("low"), "c"), form(~F.col("typed") & ~F.col("low"), "l")))
    kept = wide.select("item", "at", "size", "typed", F.explode(forms).alias("x")).select("item", "at", "size", "x.window", "x.literal", "typed").distinct()
    places = kept.groupBy("item", "at").agg(F.max("typed").alias("typed")).groupBy("item").agg(F.count_if("typed").alias("n_typed"), F.count(F.lit(1)).alias("n_all"))
    return kept.join(places.hint("merge"), "item")


def _word_hashes(words: Column, form: str) -> Column:
    """Hashes of the words of split ``marked`` text as ``template`` (t), ``started`` (s) or ``cased`` (c) has them."""
    begins, named, rest = (lambda x: x.startswith(START)), (lambda x: x.startswith(NAME)), (lambda x: F.substring(x, 2, 1 << 30))
    one = {
        "t": lambda x: F.when(named(x), NAME).when(begins(x), rest(x)).otherwise(x),
        "s": lambda x: F.when(x.startswith(NAME + UNIT), rest(x)).when(named(x) | begins(x), NAME).otherwise(x),
        "c": lambda x: F.when(named(x) | begins(x), rest(x)).otherwise(x),
    }[form]
    return F.transform(words, lambda x: F.xxhash64(one(x)))


def document_windows(rows: DataFrame, sizes: list[tuple[int, bool]], any_case: bool = False) -> DataFrame:
    """(key, pos, size, window) of every row (key, text), for each size that items have; with literal words where that is true."""
    literals = any(x for _, x in sizes)
    texts = rows.select("key", _split(marked(F.col("text"))).alias("w"), *([literal(F.col("text")).alias("l")] if literals else []))
    forms = ["t", "s", *("c" if any_case else "")]
    texts = texts.select("key", *[_word_hashes(F.col("w"), f).alias(f"h{f}") for f in forms], *([_hashes(F.col("l")).alias("hl")] if literals else []))
    # nothing as long as a text is written with a place: its windows are hashed while the places are dealt out
    each = texts.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("size"), F.lit(x).alias("literals")) for n, x in sizes])).alias("x")).select("*", "x.*")
    each = each.select("*", F.explode(F.when(F.size("ht") >= F.col("size"), F.sequence(F.lit(0), F.size("ht") - F.col("size")))).alias("pos"))
    windows = [_window(F.col(f"h{f}"), F.col("pos"), F.col("size")) for f in forms]
    if literals:
        windows.append(F.when(F.col("literals"), _window(F.col("hl"), F.col("pos"), F.col("size"))).otherwise(windows[0]))
    each = each.select("key", "pos", "size", F.array(*windows).alias("windows"))
    return each.select("key", "pos", "size", F.explode(F.array_distinct("windows")).alias("window"))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", share: float = 0.5, consistent: float = 0.9, any_case: bool = False,
) -> DataFrame:
    """(key, item, share, slots, same): items of which a row holds at least ``share`` of the windows.

    ``key`` is ``row_key`` of the row. ``slots``: placeholders of the item in matched windows; ``same``: those whose
    value is mapped as most often for it, in both directions; at least ``consistent`` of them must be. Share and slots
    are those of one alignment, the best that passes. The share is
    that of all windows or of the typed ones, whichever is more. Items under eight words are one window; null and empty
    texts hold nothing; with ``any_case`` a copy in another case, or with the same names in it, is found too; an item that occurs more often counts once.
    """
    known = cut(benchmark_windows(benchmark, item_col=item_col, text_col=item_text_col, any_case=any_case))
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    sizes = [tuple(r) for r in known.groupBy("size").agg(F.max("literal")).orderBy("size").collect()]  # at most WINDOW of them
    seen = document_windows(rows, sizes or [(WINDOW, False)], any_case)
    few = known.count() <= SEND_ROWS
    hits = seen.join(F.broadcast(known) if few else known.hint("merge"), ["window", "size"])
    kept = [F.max(c).alias(c) for c in ("size", "typed", "n_typed", "n_all")]
    hits = cut(hits.groupBy("key", "item", "at", "pos").agg(*kept).withColumn("shift", F.col("pos") - F.col("at")))
    found = cut(_alignments(hits, share))
    # slots of the matched windows, item value against document value
    text = F.col(item_text_col).cast("string")
    items = benchmark.where(text.isNotNull()).select(F.col(item_col).alias("item"), marked(text).alias("m"), originals(text).alias("o"))
    items = items.select("item", "o", template(F.col("m")).alias("t"), started(F.col("m")).alias("s"))
    token = F.transform("s", lambda x, k: F.struct(x.alias("kind"), F.get("o", k).alias("value"), ((x == NAME) & (F.get("t", k) != NAME)).alias("begins")))
    slots = items.select("item", F.posexplode(token).alias("place", "x"))
    slots = cut(slots.where(F.col("x.kind").isin(NUM, NAME, UNIT)).select("item", "place", "x.kind", "x.value", "x.begins").distinct())
    met = cut(found.join(_words_of(rows, found).hint("merge"), "key").select("key", "item", "start", "shift", "at", F.slice("o", F.col("at") + F.col("shift") + 1, F.col("size")).alias("words")))
    spread = met.select("key", "item", "start", "shift", "at", F.posexplode("words").alias("k", "other")).select("key", "item", "start", "shift", (F.col("at") + F.col("k")).alias("place"), "other")
    asked = spread.distinct().join(slots, ["item", "place"])
    clean = lambda c: F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}%]+$", "")
    pairs = asked.select("key", "item", "start", "kind", "begins", clean(F.col("value")).alias("value"), clean(F.col("other")).alias("other"))
    many = pairs.groupBy("key", "item", "start", "kind", "value", "other").agg(F.count(F.lit(1)).alias("n"), F.max(~F.col("begins")).alias("firm"))
    # a word that only begins sentences is a name's value if the document has another in its place
    alters = F.max(F.col("value") != F.col("other")).over(Window.partitionBy("key", "item", "start", "kind", "value"))
    many = many.withColumn("alters", alters).where("firm OR alters")
    there = Window.partitionBy("key", "item", "start", "kind", "value").orderBy(F.desc("n"), "other")
    back = Window.partitionBy("key", "item", "start", "kind", "other").orderBy(F.desc("n"), "value")
    many = many.withColumn("a", F.row_number().over(there)).withColumn("b", F.row_number().over(back))
    fit = many.groupBy("key", "item", "start").agg(F.sum("n").alias("slots"), F.sum(F.when((F.col("a") == 1) & (F.col("b") == 1), F.col("n")).otherwise(0)).alias("same"))
    out = found.select("key", "item", "start", "share").distinct().join(fit, ["key", "item", "start"], "left")
    out = out.select("key", "item", F.struct("share", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("same", F.lit(0)).alias("same")).alias("x"))
    return out.where(F.col("x.same") >= consistent * F.col("x.slots")).groupBy("key", "item").agg(F.max("x").alias("x")).select("key", "item", "x.*")


def _words_of(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(key, o): the words as written, of the rows with a key in ``found`` alone; equal rows once."""
    keys = cut(found.select("key").distinct())
    keys = F.broadcast(keys) if keys.count() <= SEND_ROWS else keys.hint("merge")
    return rows.join(keys, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")).select("key", originals(F.col("text")).alias("o"))


def _alignments(hits: DataFrame, share: float) -> DataFrame:
    """(key, item, start, at, shift, size, share): the ways in which a row holds at least ``share`` of an item's windows.

    One takes the first place of every window (start ANYWHERE). The others begin at each shift that occurs: of the places
    of a window that are off by no more than the item's length, the nearest, so a copy may have words put in or left out.
    """
    part = F.greatest(F.count(F.lit(1)) / F.first("n_all"), F.coalesce(F.count_if("typed") / F.nullif(F.first("n_typed"), F.lit(0)), F.lit(0.0)))
    held = lambda rows, *by: rows.groupBy("key", "item", *by).agg(part.alias("share")).where(F.col("share") >= share)
    same = [F.max(c).alias(c) for c in ("size", "typed", "n_typed", "n_all")]
    first = hits.groupBy("key", "item", "at").agg(F.min("shift").alias("shift"), *same)
    enough = cut(held(first))
    whole = first.join(enough.hint("merge"), ["key", "item"]).select("key", "item", F.lit(ANYWHERE).alias("start"), "at", "shift", "size", "share")
    reach = F.col("n_all") + WINDOW
    places = cut(hits.join(enough.hint("merge"), ["key", "item"], "left_semi").withColumn("block", F.floor(F.col("shift") / reach)))
    # shifts no farther apart than the reach lie in the same block or in neighbours
    starts = places.select("key", "item", F.col("shift").cast("bigint").alias("start"), "block").distinct()
    starts = starts.withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    off = F.abs(F.col("shift") - F.col("start"))
    near = places.join(starts.hint("merge"), ["key", "item", "block"]).where(off <= reach)
    near = cut(near.groupBy("key", "item", "start", "at").agg(F.min(F.struct(off.alias("off"), "shift"))["shift"].alias("shift"), *same))
    kept = near.join(held(near, "start").hint("merge"), ["key", "item", "start"])
    return whole.unionByName(kept.select("key", "item", "start", "at", "shift", "size", "share"))


def row_key(id_col: str, text_col: str) -> Column:
    """The same for equal rows only: the id and the text."""
    return F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))


def mark_leaks(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, leaked, items) of every row; items: ids of the benchmark items found, ascending."""
    found = cut(find_leaks(docs, benchmark, id_col=id_col, text_col=text_col, **options))
    per = found.groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))  # at most the items a text has room for
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key")).join(per, "key", "left")
    item_type = per.schema["items"].dataType.simpleString()
    out = rows.select("id", F.col("items").isNotNull().alias("leaked"), F.coalesce("items", F.array().cast(item_type)).alias("items"))
    return out.withColumnRenamed("id", id_col)
