"""Personal data and secrets replaced by keyed surrogates of the same type and format. DataFrame functions only.

An entity is what an expression finds, in a normal form (an address in lower case, a number's digits), so that all
mentions of it, however written, get one surrogate. Surrogates are drawn from a keyed digest of type and normal form:
the same everywhere without a lookup. Distinct entities are then checked for colliding surrogates, and for surrogates
that are somebody's real value; those entities draw again, until all differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectile.session import cut

SEND_ROWS = 500_000  # rows with redrawn entities up to this many, counted first, go to every task; more are shuffled
# Fixed lists: titles, and given names by gender.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Monsieur Madame".split()
MALE = "Andreas Carlos Daniel David Hans James Jean John José Juan Mark Michael Paul Peter Pierre Robert Thomas William Иван Пётр Сергей".split()
FEMALE = "Anna Clara Elena Emma Helen Julia Laura Linda Maria Marie Mary Sarah Sophie Susan Анна Мария Ольга".split()

_TITLE = rf"(?:{'|'.join(TITLES)})"
_GIVEN = rf"(?:{'|'.join(MALE + FEMALE)})"
_KEYWORD = r"(?i:password|passwd|pwd|secret|token|api.?key)"
_NAME = r"\p{Lu}\p{Ll}{1,30}"
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,5}[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    ("secret", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("secret", rf"(?<=[=:\s\"'])(?=[A-Za-z0-9_/+-]{{8}})(?<={_KEYWORD}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)[A-Za-z0-9_/+-]{{8,128}}(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\d+.])(?:\+?\d{1,3}[ .-]?)?\(\d{2,5}\)[ .-]?\d{2,4}[ .-]\d{3,4}(?!\d)"),
    ("phone", r"(?<![\d+.])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)"),
    ("phone", r"(?<![\d+.])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)"),
    ("phone", r"(?<![\d+.])\+\d{8,15}(?!\d)"),
    ("name", rf"(?=\p{{Lu}})(?<!\p{{L}}){_GIVEN}(?=\s{_NAME})"),
    ("name", rf"(?=\p{{Lu}})(?<=(?<!\p{{L}}){_TITLE}\.?\s){_NAME}"),
    ("name", rf"(?=\p{{Lu}})(?<=(?<!\p{{L}}){_GIVEN}\s){_NAME}"),
    ("name", rf"(?=\p{{Lu}})(?<=(?<!\p{{L}}){_TITLE}\.?\s\p{{Lu}}\p{{Ll}}{{1,30}}\s){_NAME}"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
# No entity without one of these; the first character of each is looked at first, as most texts have none.
QUICK = (r"[0-9@]", rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})(?!\p{{L}})", rf"[=:](?<={_KEYWORD}[\"']?\s{{0,3}}[=:])", "AKIA")


def mentions(text: Column) -> Column:
    """Entities as written, in order."""
    found = F.regexp_extract_all(text, F.lit(ANY), 0)
    hint = text.rlike(QUICK[0]) | text.rlike(QUICK[1]) | text.rlike(QUICK[2]) | text.contains(QUICK[3])
    return F.when(hint, found).otherwise(F.array().cast("array<string>"))


def entity_type(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS:
        if kind in ("email", "ip", "ssn", "card", "iban"):
            test = value.rlike(f"^(?:{pattern})$")
            out = F.when(test, kind) if out is None else out.when(test, kind)
    out = out.when(value.rlike(r"^[+(]?\d[\d ().+-]*$") & value.rlike(r"[ ().+-]"), "phone")
    out = out.when(value.isin(MALE), "given_m").when(value.isin(FEMALE), "given_f")
    return out.when(value.rlike(rf"^{_NAME}$"), "surname").otherwise("secret")


def normal_form(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind == "email", F.lower(value)).when(kind.isin("card", "phone", "ssn"), digits)
        .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).otherwise(value)
    )


def _byte(digest: Column, i) -> Column:
    """A number 0 .. 255 from place ``i`` of a hex digest of 256 bytes; longer values go round."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(256))
    return F.conv(F.substring(digest, at * 2 + 1, F.lit(2)) if not isinstance(i, int) else F.substring(digest, i % 256 * 2 + 1, 2), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


# Fixed alphabets.
LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
CYR_LOWER, CYR_UPPER = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"


def _scrambled(value: Column, digest: Column, lower: str = LOWER, digits: str = DIGITS) -> Column:
    """Each letter and digit by one of its script and case."""

    def char(c: Column, i: Column) -> Column:
        n = _byte(digest, i)
        return (
            F.when(c.rlike("[0-9]"), _pick(digits, n)).when(c.rlike("[a-z]"), _pick(lower, n)).when(c.rlike("[A-Z]"), _pick(UPPER, n))
            .when(c.rlike("[а-яё]"), _pick(CYR_LOWER, n)).when(c.rlike("[А-ЯЁ]"), _pick(CYR_UPPER, n)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), char), "")


def _luhn(digits: Column) -> Column:
    """Sum that is a multiple of ten for a valid number."""
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda c, i: F.when((n - i) % 2 == 0, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _syllables(digest: Column, attempt: Column, cyrillic: Column, female: Column) -> Column:
    """A name that can be spoken; ends in a vowel for a woman, else in a consonant. Every redraw adds a syllable."""

    def name(heads: str, cons: str, vowels: str, ends: str, last: str) -> Column:
        mid = F.array_join(F.transform(F.sequence(F.lit(1), attempt + 2), lambda i: F.concat(_pick(vowels, _byte(digest, i * 2)), _pick(cons, _byte(digest, i * 2 + 1)))), "")
        return F.concat(_pick(heads, _byte(digest, 0)), mid, F.when(female, F.lit(last)).otherwise(F.concat(_pick(vowels, _byte(digest, 1)), _pick(ends, _byte(digest, 200)))))

    latin = name("BCDFGHJKLMNPRSTV", "bcdfghklmnprstvz", "aeiou", "nrslmtk", "a")
    return F.when(cyrillic, name("БВГДЖЗКЛМНПРСТФХ", "бвгдзклмнпрстфх", "аеиоу", "нрслмтк", "а")).otherwise(latin)


def items(found: Column) -> Column:
    """Mentions as structs of value, kind, normal form and attempt 0."""
    typed = F.transform(found, lambda v: F.struct(v.alias("value"), entity_type(v).alias("kind")))
    return F.transform(typed, lambda x: F.struct(x["value"].alias("value"), x["kind"].alias("kind"), normal_form(x["kind"], x["value"]).alias("normal"), F.lit(0).alias("attempt")))


def draw(entities: Column, key: str) -> Column:
    """``items`` with a field new: the replacement of the normal form, itself a normal form of the type.

    Step by step, so that a digest or a scrambled form is worked out once for an entity.
    """
    seeded = F.transform(entities, lambda x: F.struct(
        x["value"].alias("value"), x["kind"].alias("kind"), x["normal"].alias("normal"), x["attempt"].alias("attempt"),
        F.concat_ws("\x1f", F.lit(key), x["kind"], x["normal"], x["attempt"].cast("string")).alias("seed"),
    ))
    digested = F.transform(seeded, lambda x: F.struct(
        x["value"].alias("value"), x["kind"].alias("kind"), x["normal"].alias("normal"), x["attempt"].alias("attempt"),
        F.concat(*[F.sha2(F.concat(x["seed"], F.lit(f"\x1f{i}")), 256) for i in range(8)]).alias("digest"),
    ))
    mixed = F.transform(digested, lambda x: x.withField("mixed", F.when(x["kind"].startswith("given") | (x["kind"] == "surname"), "").when(
        (x["kind"] == "secret") & x["normal"].rlike("^[0-9a-f]+$"), _scrambled(x["normal"], x["digest"], HEX, HEX)
    ).otherwise(_scrambled(x["normal"], x["digest"]))))
    return F.transform(mixed, lambda x: x.withField("new", _shaped(x["kind"], x["normal"], x["attempt"], x["digest"], x["mixed"])))


def _shaped(kind: Column, normal: Column, attempt: Column, digest: Column, mixed: Column) -> Column:
    """What the scrambled form must keep: top-level domain, country code, card validity, key prefix."""
    n = F.length(normal)
    top = F.length(F.substring_index(normal, ".", -1))
    email = F.concat(F.substring(mixed, F.lit(1), n - top), F.substring_index(normal, ".", -1))
    ip = F.concat_ws(".", *[(_byte(digest, i) % 254 + 1).cast("string") for i in range(4)])
    body = F.concat(F.substring(normal, 1, 1), F.substring(mixed, F.lit(2), n - 2))
    closing = F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
    card = F.when(_luhn(normal) % 10 == 0, F.concat(body, closing)).otherwise(F.concat(F.substring(normal, 1, 1), F.substring(mixed, F.lit(2), n)))
    lead = F.when((n == 11) & normal.startswith("1"), F.lit("1")).otherwise(F.substring(mixed, 1, 1))
    fictional = (attempt == 0) & (n > 7) & (F.substring(normal, n - 6, F.lit(3)) == "555")
    phone = F.when(fictional, F.concat(lead, F.substring(mixed, F.lit(2), n - 8), F.lit("555"), F.substring(mixed, n - 3, F.lit(4)))).otherwise(F.concat(lead, F.substring(mixed, F.lit(2), n)))
    secret = F.when(normal.startswith("AKIA"), F.concat(F.lit("AKIA"), F.substring(mixed, F.lit(5), n))).otherwise(mixed)
    iban = F.concat(F.substring(normal, 1, 2), F.substring(mixed, F.lit(3), n))
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", mixed)
        .when(kind == "iban", iban).when(kind == "secret", secret).otherwise(_syllables(digest, attempt, normal.rlike(r"\p{IsCyrillic}"), kind == "given_f"))
    )


def _written(value: Column, kind: Column, new: Column) -> Column:
    """The new normal form in the format of this mention."""
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"[^0-9A-Z]", "")) + 1
    poured = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9A-Z]"), F.substring(new, place(i), F.lit(1))).otherwise(c)), "")
    return F.when(kind.isin("card", "phone", "ssn", "iban"), poured).otherwise(new)


def redrawn(rows: DataFrame, key: str) -> DataFrame:
    """(kind, normal, attempt) of the entities whose first draw won't do; ``rows`` has an array ``found`` of mentions."""
    each = rows.select(F.explode(items(F.col("found"))).alias("x"))
    known = cut(each.select("x.kind", "x.normal").distinct())
    state = known.withColumn("attempt", F.lit(0))
    while True:
        one = F.array(F.struct(F.col("normal").alias("value"), "kind", "normal", "attempt"))
        drawn = cut(state.select("kind", "normal", "attempt", F.element_at(draw(one, key), 1)["new"].alias("new")))
        first = drawn.groupBy("new").agg(F.min(F.struct("attempt", "kind", "normal")).alias("first"), F.count(F.lit(1)).alias("n"))
        twice = drawn.join(first.where("n > 1"), "new").where("NOT (kind = first.kind AND normal = first.normal)").select("kind", "normal")
        real = drawn.join(known.select(F.col("normal").alias("new")).distinct(), "new", "left_semi").select("kind", "normal")
        again = cut(twice.unionByName(real).distinct())
        if again.isEmpty():
            return state.where("attempt > 0")
        state = cut(state.join(again.withColumn("more", F.lit(1)), ["kind", "normal"], "left").select("kind", "normal", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")))


def replace_entities(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """All columns and rows of ``docs`` with every entity in ``text_col`` replaced; ``count_col``, if named, has how many.

    Found are mail and IP addresses, phone, card, social security and account numbers, access keys and passwords after
    their name, and names after a title or a common given name. A surrogate keeps type, format, case and script, a card
    number its validity, a given name its gender. The same key gives the same surrogate for one entity wherever it is
    mentioned; different entities of the table get different ones. Null stays null, with count 0.
    """
    text = F.col(text_col).cast("string")
    found = mentions(text)
    row = F.xxhash64(F.col(id_col), text)
    mentioned = cut(docs.select(row.alias("row"), found.alias("found")).where(F.size("found") > 0))
    names = iter(f"_pii{i}" for i in range(100) if f"_pii{i}" not in docs.columns)
    new, key_col, other = next(names), next(names), next(names)
    others = cut(_redrawn_rows(mentioned, key)).toDF(key_col, other)
    few = others.count() <= SEND_ROWS
    out = docs.withColumn(key_col, row).join(F.broadcast(others) if few else others.hint("merge"), key_col, "left")
    fresh = F.transform(draw(items(found), key), lambda x: _written(x["value"], x["kind"], x["new"]))
    out = out.withColumn(new, F.coalesce(F.col(other), fresh))
    rest = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(rest, F.concat(F.col(new), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    some = F.coalesce(F.size(new), F.lit(0))
    some = F.when(some < 0, 0).otherwise(some)
    if count_col:
        out = out.withColumn(count_col, some.cast("bigint"))
    out = out.withColumn(text_col, F.when(some > 0, joined).otherwise(text))
    return out.select(*docs.columns, *([count_col] if count_col else []))


def _redrawn_rows(mentioned: DataFrame, key: str) -> DataFrame:
    """(row, replacements in order) of the rows that mention an entity whose first draw won't do."""
    exceptions = cut(redrawn(mentioned, key))
    one = F.posexplode(items(F.col("found"))).alias("at", "x")
    each = mentioned.distinct().select("row", one).select("row", "at", "x.value", "x.kind", "x.normal")
    tried = each.join(exceptions, ["kind", "normal"], "left")
    hit = tried.where("attempt IS NOT NULL").select("row").distinct()
    tried = tried.join(hit, "row", "left_semi").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    drawn = F.element_at(draw(F.array(F.struct("value", "kind", "normal", "attempt")), key), 1)
    fresh = tried.select("row", "at", "value", "kind", drawn["new"].alias("new")).select("row", "at", _written(F.col("value"), F.col("kind"), F.col("new")).alias("new"))
    return fresh.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("new"))
