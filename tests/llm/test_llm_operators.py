"""The operators against brute force, on the smallest tables and on odd rows."""

import collections
import hashlib
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def rows_of(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# words ---------------------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    from vectile.llm import words as W

    texts = ["a bb", None, "", " x\ty\x0bz ", "é\u00a0ü 漢", "a bb"]
    w = W.words_of(pa.array(texts))
    got = [w.buf[s:e].tobytes().decode() for s, e in zip(w.start, w.end)]
    assert got == [x for t in texts for x in words(t)]
    assert list(w.counts) == [len(words(t)) for t in texts]
    h = W.word_hashes(w)
    assert (h[:2] == h[-2:]).all() and len(set(h.tolist())) == len(set(got))
    r = W.rolling(np.tile(h, 40), 3)
    assert len(np.unique(r)) == len(h) and (r[: len(h)] == r[len(h) : 2 * len(h)]).all()


def test_long_spans_hash_alike(monkeypatch):
    from vectile.llm import words as W

    w = W.words_of(pa.array(["ab " * 50 + "x" * 300 + " ab"]))
    h = W.word_hashes(w)
    monkeypatch.setattr(W, "PIECE_BYTES", 16)
    assert (W.word_hashes(w) == h).all()


def test_hashing_a_piece_keeps_few_powers(monkeypatch):
    from vectile.llm import words as W

    monkeypatch.setattr(W, "_POWERS", {})
    w = W.words_of(pa.array(["abc def " * (W.PIECE_BYTES // 8)]))
    W.word_hashes(w)
    assert len(W._POWERS[0][0]) <= W.PIECE_BYTES // 4


# op1 -----------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, window):
    split = [words(t) for t in texts]
    seen = collections.Counter(tuple(w[p : p + window]) for w in split for p in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone[p : p + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


@pytest.mark.parametrize("window", [1, 3, 35])
def test_remove_repeats(docs, odd, none, window, monkeypatch):
    from vectile.llm import substring_dedup as S

    monkeypatch.setattr(S, "FLUSH", 500)  # several flushes a task
    for df in (docs, odd):
        own = df.select("doc_id", "text").collect()
        want = collections.Counter((r["doc_id"], *b) for r, b in zip(own, brute_repeats([r["text"] for r in own], window)))
        assert rows_of(S.remove_repeats(df, window=window), "doc_id", "n_words", "n_removed", "text") == want
    assert S.remove_repeats(none).count() == 0


# op2 -----------------------------------------------------------------------------------------------------------------


def brute_sets(texts):
    out = []
    for t in texts:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else []))
    return out


def brute_components(sets, linked):
    boss = list(range(len(sets)))

    def top(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if linked(sets[x], sets[y]):
                a, b = top(x), top(y)
                boss[max(a, b)] = min(a, b)
    return [top(x) for x in range(len(sets))]


def near(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 90 * len(a | b)


def mutated(seed=3, families=6, each=12):
    rng = np.random.default_rng(seed)
    out = []
    for f in range(families):
        base = [f"w{rng.integers(400)}" for _ in range(rng.integers(3, 160))]
        for _ in range(each):
            w = list(base)
            for k in rng.integers(0, len(w), rng.integers(0, 1 + len(w) // 40 + 1)):
                w[k] = f"v{rng.integers(10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("region", [2000, 3])
def test_jaccard_components(spark, region, monkeypatch):
    from vectile.llm import jaccard_join as J

    monkeypatch.setattr(J, "REGION", region)  # 3: every family is split into regions or tiles
    monkeypatch.setattr(J, "PIVOTS", 4)
    texts = mutated()
    sets = brute_sets(texts)
    want = brute_components(sets, near)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(df).collect()}
    assert got == {k: (len(sets[k]), want[k]) for k in range(len(texts))}


def test_large_regions_are_cut_by_their_own_grams(spark, monkeypatch):
    """Texts in one region that share few n-grams part; near ones stay together; small regions stay as they are."""
    from vectile.llm import jaccard_join as J

    monkeypatch.setattr(J, "REGION", 20)
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.integers(0, 1 << 63, 60, dtype=np.uint64), rng.choice(shared, 12, replace=False)])) for _ in range(200)]
    for k in range(0, 60, 3):  # near ones by a few n-grams, and a third one near the second
        for far in (1, 2):
            grown = np.concatenate([sets[k + far - 1][3:], rng.integers(0, 1 << 63, 3, dtype=np.uint64)])
            sets[k + far] = np.unique(grown)
    rows = [(7, k, bytes(x.tobytes())) for k, x in enumerate(sets)] + [(8, 1000 + k, bytes(sets[k].tobytes())) for k in (0, 1, 90)]
    points = spark.createDataFrame(rows, "region long, class long, grams binary").repartition(5)
    for percent in (80, 90):
        out = J._apart(points, percent).collect()
        at = {r["class"]: r["region"] for r in out}
        assert len(at) == len(out) and {at[1000], at[1001], at[1090]} == {8}
        linked = {(i, j) for i in range(200) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
        assert len(linked) >= 40 and all(at[i] == at[j] for i, j in linked)
        assert len([k for k in at if k < 1000]) < 100 and len({at[k] for k in at if k < 60}) == 20


def test_jaccard_odd(odd, none):
    from vectile.llm.jaccard_join import jaccard_components

    got = rows_of(jaccard_components(odd), "doc_id", "n_shingles", "component_id")
    assert got[(0, 0, 0)] == 1 and got[(6, 4, 6)] == 2 and got[(7, 4, 6)] == 1 and got[(3, 1, 3)] == 1 and got[(None, 0, None)] == 1
    assert sum(got.values()) == odd.count()
    assert jaccard_components(none).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_links_of_a_region(percent):
    from vectile.llm.jaccard_join import component_links

    rng = np.random.default_rng(percent)
    for _ in range(20):
        base = [set(rng.integers(0, 60, rng.integers(1, 40)).tolist()) for _ in range(4)]
        sets = []
        for _ in range(25):
            s = set(base[rng.integers(4)])
            s -= set(rng.choice(sorted(s), min(len(s) - 1, rng.integers(0, 4)), replace=False).tolist()) if len(s) > 1 else set()
            sets.append(s | {int(rng.integers(60))})
        want = brute_components(sets, lambda a, b: 100 * len(a & b) >= percent * len(a | b))
        n = np.array([len(s) for s in sets])
        flat = np.array([x for s in sets for x in sorted(s)], dtype=np.uint64)
        i, j = component_links(n, flat, np.cumsum(n) - n, percent)
        pairs = set(zip(i.tolist(), j.tolist()))
        assert all(100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) for a, b in pairs)
        boss = brute_components(list(range(25)), lambda a, b: (a, b) in pairs or (b, a) in pairs)
        assert boss == want


# op3 -----------------------------------------------------------------------------------------------------------------


def test_language(spark, odd, none):
    from vectile.llm.language_id import fit, held_out, predict

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs, ~held_out("doc_id"), per_language=200, landmarks=20)
    got = predict(docs, model).join(docs.select("doc_id", "lang", held_out("doc_id").alias("held")), "doc_id").toPandas()
    assert got["held"].sum() == sum(zlib.crc32(str(k).encode()) % 3 == 1 for k in got["doc_id"])
    assert (got["lang"] == got["lang_pred"])[got["held"]].mean() > 0.97 and got["score"].between(0, 1).all()
    some = {r["doc_id"]: r for r in predict(odd, model).collect()}
    assert len(predict(odd, model).collect()) == odd.count()
    assert [some[k]["lang_pred"] for k in (0, 1, 2)] == ["und"] * 3 and some[8]["lang_pred"] in model.languages
    empty = fit(none, held_out("doc_id"))
    assert {r["lang_pred"] for r in predict(odd, empty).collect()} == {"und"} and predict(none, model).count() == 0


# op4 -----------------------------------------------------------------------------------------------------------------

QUESTION = "Anna met Tom at the market and bought 12 apples for 3 dollars then she gave Tom 5 apples back and left"


def test_leaks(spark, docs, odd, none):
    from vectile.llm.decontaminate import mark_leaks

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], i) for r in mark_leaks(docs, bench).collect() for i in r["items"]}
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in bench.collect()]
    assert got == {(r["doc_id"], i) for r in docs.collect() for i, t in items if t in " ".join(words(r["text"]))}
    asked = spark.createDataFrame([(1, QUESTION), (2, None), (3, ""), (4, "too short"), (1, QUESTION)], "item_id long, text string")
    texts = [
        "Well. We saw how Mary met John at the market and bought 20 apples for 7 dollars then she gave John 9 apples back and left. End",
        "Mary met John at the market and bought 20 apples for 7 dollars then she gave Peter 20 apples back and left",  # John is Peter too
        "Mary met John at the market and bought", QUESTION.upper(), None, "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["leaked"] for r in mark_leaks(df, asked).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False}
    assert mark_leaks(odd, asked).where("leaked").count() == 0 and mark_leaks(odd, asked).count() == odd.count()
    assert mark_leaks(none, asked).count() == 0 and mark_leaks(odd, asked.limit(0)).where("leaked").count() == 0


def test_leaks_at_any_place(spark):
    from vectile.llm.decontaminate import mark_leaks

    items = [
        "add 3 and 5 to get the first sum then add 4 and 6 to get the first sum then add 7 and 9 to get the first sum",
        "what is the sum of 12 and 7 in base 10 what is the sum of 15 and 9 in base 8", QUESTION,
    ]
    part = "she saw how Mary met John at the market and bought 20 apples for 20 dollars then she gave Mary 20 apples"
    far = " ".join(f"x{k}" for k in range(50))
    grown = QUESTION.replace("and bought", "and then quite happily bought")
    texts = [*items, f"{part} {far} {items[2]}", f"{part} {far} {grown}", f"{items[0]} {far} {items[0]}", items[0].replace("4 and 6", "3 and 3").replace("7 and 9", "5 and 5"), part]
    want = [[0], [1], [2], [2], [2], [0], [], []]
    got = mark_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in got.collect()} == dict(enumerate(want))


def test_leaks_of_short_and_dense_items(spark):
    from vectile.llm.decontaminate import mark_leaks

    items = ["What is 12 times 13?", "Add 3.5 kg", "Paris", "12 km 14 km 15 km 16 km 17 km 18 km", "", "...", None]
    texts = [f"He asked: {items[0]} Now", "what is 12 times 14", "then add 3.5 kg.", "add 35 kg", "to Paris, then", f"x {items[3]} y", items[3].replace("15", "95").replace("17", "97"), "", None]
    want = [[0], [], [1], [], [2], [3], [], [], []]
    got = mark_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in got.collect()} == dict(enumerate(want))


def test_leaks_in_any_case(spark):
    from vectile.llm.decontaminate import mark_leaks

    german = "Der Hund von Herrn Maier lief am Morgen über die Straße zum Bäcker und brachte Brot nach Hause"
    starts = "Anna has 5 apples. Tom has 7 pears. Anna gives Tom 2 apples. Tom eats 3 pears. Anna sleeps."
    items = [QUESTION, german, starts]
    texts = [f(t) for t in (QUESTION, german) for f in (str.upper, str.title, str.lower)]
    texts += [starts.replace("Anna", "Mary").replace("Tom", "John"), "Mary has 5 apples. John has 7 pears. Peter gives Paul 2 apples. Clara eats 3 pears. Laura sleeps."]
    docs, bench = (spark.createDataFrame(list(enumerate(x)), f"{name} long, text string") for x, name in ((texts, "doc_id"), (items, "item_id")))
    got = {r["doc_id"]: r["items"] for r in mark_leaks(docs, bench, any_case=True).collect()}
    assert got == dict(enumerate([[0]] * 3 + [[1]] * 3 + [[2], []]))
    known = spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id", "text", "item_id AS doc_id")
    for form in ("upper(text)", "initcap(text)", "lower(text)"):
        found = mark_leaks(known.selectExpr("doc_id", f"{form} AS text"), known.drop("doc_id"), any_case=True).collect()
        assert all(r["doc_id"] in r["items"] for r in found)


def test_windows_go_without_words(spark, odd):
    from pyspark.sql import functions as F

    from vectile.llm import decontaminate as D

    texts = ["He met Anna. She paid 12 Dollars, then (Tom) 3 kg of O'Neil's \"Rice\" 7 Days 5\n\n\n\nMeters ABC! " + QUESTION, "ÜBER die Straße İst É é\u0301 x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "key long, text string").unionByName(odd.select(F.col("doc_id").alias("key"), "text"))
    mark = D.marked(F.col("text"))
    for form, whole in (("t", D.template), ("s", D.started), ("c", D.cased)):
        assert rows.where(~D._word_hashes(D._split(mark), form).eqNullSafe(D._hashes(whole(mark)))).count() == 0
    seen = D.document_windows(rows, [(8, False), (2, True)], True)
    assert seen.columns == ["key", "pos", "size", "window"]  # and no generator, which runs for each place, interprets a function
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Generate" in x and "lambda" in x]
    literal = rows.where("key = 0").select(D._window(D._hashes(D.literal(F.col("text"))), F.lit(3), F.lit(2)).alias("w")).first()[0]
    assert seen.where(f"key = 0 AND pos = 3 AND size = 2 AND window = {literal}").count() >= 1


# op5 -----------------------------------------------------------------------------------------------------------------


def luhn(n):
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(n))) % 10 == 0


def test_surrogates(spark, odd, none):
    from vectile.llm.pii import replace_entities

    text = (
        "Dr. Anna Smith wrote to Mr Smith (Anna.Smith@mail.org, anna.smith@mail.org); SSN 123-45-6789. "
        "+1 (386) 555-3733 or 1-386-555-3733. Card 4111 1111 1111 1111, 4111111111111111. At 1.2.3.4, password=abc123def456. Иван Петров. v3.0 in 2024"
    )
    df = spark.createDataFrame([(1, text, 5), (2, "mail anna.smith@mail.org", 6), (3, None, 7), (4, "none here", 8)], "doc_id long, text string, count long")
    out = {r["doc_id"]: r for r in replace_entities(df, key="k", count_col="found").collect()}
    new = out[1]["text"]
    assert out[3]["text"] is None and out[4]["text"] == "none here" and [out[k]["found"] for k in (2, 3, 4)] == [1, 0, 0] and out[1]["count"] == 5
    for gone in ("Anna", "Smith", "mail.org", "123-45", "386", "4111", "1.2.3.4", "abc123", "Иван"):
        assert gone not in new
    mails = re.findall(r"[\w.]+@[\w.]+\.org", new)
    assert len(mails) == 2 and len(set(mails)) == 1 and out[2]["text"] == "mail " + mails[0]
    cards = re.findall(r"4\d{3} ?\d{4} ?\d{4} ?\d{4}", new)
    assert len(cards) == 2 and len({c.replace(" ", "") for c in cards}) == 1 and luhn(cards[1])
    phones = re.findall(r"\+?1[ -]\(?\d{3}\)?[ -]555-\d{4}", new)
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and len(phones) == 2
    name = re.match(r"Dr\. (\w+a) (\w+) wrote to Mr (\w+) ", new)
    assert name and name[2] == name[3] and re.search(r"[А-Я][а-я]+ [А-Я][а-я]+\. v3\.0 in 2024$", new)
    other = replace_entities(df, key="other").where("doc_id = 2").first()["text"]
    assert other != out[2]["text"]
    assert replace_entities(odd, key="k").columns == odd.columns and replace_entities(odd, key="k").count() == odd.count()
    assert replace_entities(none, key="k").count() == 0


def test_surrogates_differ(spark):
    """So many short numbers that first draws collide: all must end up different, and nobody's real number."""
    from vectile.llm.pii import replace_entities

    real = [f"{100 + k:03d}-{k % 90 + 10:02d}-{k * 37 % 9000 + 1000:04d}" for k in range(400)] + [f"10.0.{k // 250}.{k % 250}" for k in range(400)]
    df = spark.createDataFrame([(k, f"id {v} again {v}") for k, v in enumerate(real)], "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split() for r in replace_entities(df, key="x").collect()}
    assert all(t[1] == t[3] for t in got.values())
    new = [got[k][1] for k in range(len(real))]
    assert len(set(new)) == len(real) and not set(new) & set(real)


def test_redrawn_entities(spark, monkeypatch):
    """With draws cut to a hundred values collisions are certain."""
    from pyspark.sql import functions as F

    from vectile.llm import pii

    shaped = pii._shaped
    monkeypatch.setattr(pii, "_shaped", lambda kind, normal, attempt, digest, mixed: F.when(
        attempt < 2, F.concat(F.lit("9.9.9."), (pii._byte(digest, 0) % 10).cast("string"))
    ).otherwise(shaped(kind, normal, attempt, digest, mixed)))
    real = [f"10.0.0.{k}" for k in range(60)]
    df = spark.createDataFrame([(k, f"at {v}") for k, v in enumerate(real)], "doc_id long, text string")
    new = [r["text"].split()[1] for r in pii.replace_entities(df, key="x").collect()]
    assert len(set(new)) == 60 and not set(new) & set(real)


# op6, op8 ------------------------------------------------------------------------------------------------------------


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


@pytest.mark.parametrize("name, fold", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_ids_are_the_librarys(name, fold):
    from tokenizers import Tokenizer

    from vectile.llm.queries import tokenizer
    from vectile.llm.tokens import Encoder

    rng = np.random.default_rng(7)
    alphabet = list(" \n\t.,;'sSTt aA9!<|>—…İ") + ["é", "e\u0301", "H\u0331", "\u0085", "\x1c", "<|endoftext|>", " the", "ng", "中"]
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(4000)] + [None, "", " ", "\n", "it's a.\nB C ", "<|EndOfText|> A"]
    ref = Tokenizer.from_file(tokenizer(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)
    ids, bounds = Encoder(tokenizer(name), fold).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [x.ids for x in ref]


def test_a_worker_keeps_few_stretches(monkeypatch):
    from tokenizers import Tokenizer

    from vectile.llm import tokens
    from vectile.llm.queries import tokenizer

    asked, encoded = [], tokens._encoded
    monkeypatch.setattr(tokens, "_encoded", lambda lib, texts: asked.append(len(texts)) or encoded(lib, texts))
    monkeypatch.setattr(tokens, "KEEP", 300)
    monkeypatch.setattr(tokens, "AT_ONCE", 64, raising=False)
    texts = [f"it is number {i} of\nmany words{i % 40}, told again" for i in range(4000)]
    name = "byte_bpe_50k.json"
    ref = [x.ids for x in Tokenizer.from_file(tokenizer(name)).encode_batch(texts, add_special_tokens=False)]
    encoder, held = tokens.Encoder(tokenizer(name)), []
    for lo in range(0, 4000, 200):
        ids, bounds = encoder.encode(pa.array(texts[lo : lo + 200]))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == ref[lo : lo + 200]
        held.append(len(encoder.hashes))
    assert max(held) <= 300 + 250 and max(asked) <= 64
    assert sum(asked) < 4000 + 500  # what every part of the texts has is tokenized once, not after each time of forgetting


@pytest.mark.parametrize("size", [1024, 16])
def test_packing(docs, odd, none, size):
    from tokenizers import Tokenizer

    from vectile.llm.packing import pack_documents
    from vectile.llm.queries import tokenizer

    path = tokenizer("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for df in (docs, odd):
        out = pack_documents(df, path, size=size, with_ids=True).toPandas()
        own = collections.Counter((r["doc_id"], tuple([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0])) for r in df.collect())
        assert all(crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length for r in out.itertuples())
        pieces = collections.Counter()
        for (i, ids), many in own.items():
            for s in range(0, len(ids), size):
                pieces[(i, s, tuple(ids[s : s + size]), len(ids))] += many
        got = collections.Counter((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, tuple(r.ids), r.doc_tokens) for r in out.itertuples())
        assert got == pieces
        out = out.sort_values(["sequence_id", "offset"])
        used = out.groupby("sequence_id")["length"]
        assert (out["offset"] == used.cumsum() - out["length"]).all() and used.sum().max() <= size
    assert pack_documents(none, path).count() == 0


def test_patterns_use_every_length():
    from vectile.llm.packing import patterns

    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = {int(k): int(rng.integers(1, 50)) for k in rng.integers(1, 65, rng.integers(1, 40))}
        plan = patterns(counts, 64)
        got = collections.Counter()
        for n, lengths in plan:
            assert n > 0 and sum(lengths) <= 64
            for x in lengths:
                got[x] += n
        assert dict(got) == counts and len(plan) <= 2 * len(counts) + 1


def test_wavelet():
    from vectile.llm.wavelet import Wavelet

    rng = np.random.default_rng(2)
    for n, top in ((0, 1), (1, 1), (513, 2), (5000, 300), (4096, 70000)):
        x = rng.integers(0, top, n).astype(np.uint32)
        w = Wavelet.build(x)
        assert (w.decode() == x).all() and (w.access(np.arange(n)) == x).all()
        for t in [*np.unique(x)[:20].tolist(), top + 1]:
            assert w.count(t) == (x == t).sum() and (w.locate(t) == np.flatnonzero(x == t)).all()
            assert w.count(t, n // 3, n - n // 5) == (x[n // 3 : n - n // 5] == t).sum()


def test_token_files(spark, docs, odd, none, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    from vectile.llm import wavelet
    from vectile.llm.queries import tokenizer

    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 5000)  # several shards a file
    path = tokenizer("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for k, df in enumerate((docs, odd)):
        to = str(tmp_path / f"t{k}")
        wavelet.write_tokens(df, to, path, fold=True)
        own = sorted(df.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
        ids = [[*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in own]
        starts = np.cumsum([0, *map(len, ids)])
        want = collections.Counter((r["doc_id"], int(s), len(x), crc(x)) for r, s, x in zip(own, starts, ids))
        assert rows_of(wavelet.read_tokens(spark, to), "id", "start", "n_tokens", "ids_crc32") == want
        token = collections.Counter(t for x in ids for t in x).most_common(3)[2][0]
        assert wavelet.count_token(spark, to, token).groupBy().sum("n").first()[0] == sum(x.count(token) for x in ids)
        places = rows_of(wavelet.locate_token(spark, to, token), "id", "position")
        assert places == collections.Counter((r["doc_id"], p) for r, x in zip(own, ids) for p, t in enumerate(x) if t == token)
    wavelet.write_tokens(none, str(tmp_path / "none"), path, fold=True)
    assert wavelet.read_tokens(spark, str(tmp_path / "none")).count() == 0


# op7 -----------------------------------------------------------------------------------------------------------------


def brute_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def brute_rule(host, path, rules):
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name)) if fit else None


def test_urls(spark):
    from vectile.llm.queries import URL_RULES
    from vectile.llm.url_filter import judge_urls

    link = '<link rel="canonical" href="https://ok.example.com/x">'
    move = "<meta http-equiv='refresh' content='0; url=http://c.info/z'>"
    rows = [
        (1, "http://Evil.net/a", link), (2, "https://ok.example.com/x/?utm_source=q", None), (3, None, ""), (4, "", None), (5, "nourl", ""),
        (6, "http://b.example.net/en/q", move), (7, "http://www.c.info/z#top", ""), (8, "http://x.net", ""), (8, "http://x.net", ""),
        (9, "http://x.NET/", ""), (10, "ftp://a.example.com/de/1?q=/en/", ""), (11, "a://b://c.net/x", ""), (12, "http://example.net/en/1", move), (13, "http://notnet/", ""),
        (14, "http://d.info/1", '<link rel="canonical" href="http://e.info/2">'), (15, "http://q.net/w", '<link href="http://d.info/1" rel=canonical>'), (16, "http://e.info/2", ""),
    ]
    out = judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()
    assert len(out) == len(rows)
    url = {r[0]: r[1] for r in rows}
    for r in out:
        host, path = brute_url(url[r["page_id"]])
        rule = brute_rule(host, path, URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None)
        if rule:
            assert r["verdict"] == rule.verdict
    says = {r["page_id"]: r["verdict"] for r in out}
    assert says[2] == "block" and says[7] == "allow" and says[14] == "block" and says[16] == "block" and says[8] == "block" and {says[k] for k in (3, 4, 5, 13)} == {"allow"}  # 8 is 9 with another ending
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(empty, URL_RULES).count() == 0


def test_links_of_all_forms(spark):
    from pyspark.sql import functions as F

    from vectile.llm.queries import URL_RULES
    from vectile.llm.url_filter import declared_links, judge_urls, resolved

    url = "http://a.info/x/y/z?q=1#f"
    canon = ['"/en/x"', "'?p=1&amp;b=2'", "//b.net/c", "w", "../v/", "./u", "..", '"#top"', "https://c.org/d", "mailto:x", '" /s "']
    want = ["http://a.info/en/x", "http://a.info/x/y/z?p=1&b=2", "http://b.net/c", "http://a.info/x/y/w", "http://a.info/x/v/", "http://a.info/x/y/u", "http://a.info/x/", url[:-2] + "#top", "https://c.org/d", None, "http://a.info/s"]
    html = [f"<link rel=canonical href={c}>" for c in canon]
    moves = ["""content="0;url='https://b.net/c'" """, "content='3; URL=/r?a=1&amp;b=2'", "content=0;url=q"]
    html += [f"<meta http-equiv=refresh {m}>" for m in moves]
    want += ["https://b.net/c", "http://a.info/r?a=1&b=2", "http://a.info/x/y/q"]
    df = spark.createDataFrame(list(enumerate(html)), "k long, html string").select("k", F.explode(declared_links(F.col("html"))).alias("x"))
    assert {r["k"]: r["to"] for r in df.select("k", resolved(F.col("x"), F.lit(url)).alias("to")).collect()} == dict(enumerate(want))
    pages = [(1, "http://d.info/1", "<link rel=canonical href=//evil.net/a>"), (2, "http://evil.net/a", ""), (3, "http://d.info/2", "<link rel='canonical' href='/1'>")]
    out = judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), URL_RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {1: "block", 2: "block", 3: "block"}


def test_urls_are_judged_without_python(spark, monkeypatch):
    from vectile.llm.queries import URL_RULES
    from vectile.llm.url_filter import judge_urls

    pages = [(k, f"http://h{k}.info/{k}", f"<link rel=canonical href=http://h{k + 1}.info/{k + 1}>") for k in range(40)] + [(40, "http://h40.info/40", "<link rel=canonical href=//evil.net/a>")]
    df = spark.createDataFrame([*pages, (41, "http://evil.net/a", ""), (42, "http://other.info/", "")], "page_id long, url string, html string")
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(df), name, lambda *_: pytest.fail("Python on the executors"))
    out = judge_urls(df, URL_RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {k: "block" for k in range(42)} | {42: "allow"}


# op9, op10 -----------------------------------------------------------------------------------------------------------


def test_accuracies_are_found():
    """Votes of labellers with known accuracies on known classes."""
    from vectile.llm.weak_labels import fit_accuracies

    rng = np.random.default_rng(4)
    bad = rng.random(40_000) < 0.2
    right = [(0.6, 0.02), (0.5, 0.05), (0.7, 0.01), (0.4, 0.03)]  # says bad of bad, of good
    votes = np.stack([np.where(rng.random(len(bad)) < np.where(bad, p, q), 1, -1) for p, q in right] + [np.where(rng.random(len(bad)) < np.where(bad, 0.05, 0.8), 0, -1)], axis=1)
    patterns, back, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, table, converged = fit_accuracies(patterns, n)
    assert converged and np.abs(table[1, :4, 2] - [p for p, _ in right]).max() < 0.03 and np.abs(table[0, :4, 2] - [q for _, q in right]).max() < 0.02
    assert ((post[back] > 0.5) == bad).mean() > 0.95


def test_classifier(spark, odd, none):
    from vectile.llm.weak_labels import REJECT_FROM, score_documents, train

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model, report = train(docs, labels)
    got = score_documents(docs, model).join(labels, "doc_id").toPandas()
    reject = got["score"] >= REJECT_FROM
    assert reject[got["quality"] == 0].mean() > 0.9 and reject[got["toxic"] == 1].mean() > 0.6
    assert reject[(got["quality"] == 1) & (got["toxic"] == 0)].mean() < 0.03 and len(report)
    scored = score_documents(odd, model)
    assert scored.columns == [*odd.columns, "score"] and scored.count() == odd.count()
    assert [r["score"] for r in scored.where("doc_id < 3").collect()] == [1.0, 1.0, 1.0]
    idle, _ = train(none, labels)
    assert score_documents(none, idle).count() == 0 and score_documents(odd, idle).where("doc_id = 4").first()["score"] < 0.1
    train(odd, labels.limit(0))


def test_features_take_bounded_memory(monkeypatch):
    """A worker holds the arrays of a piece, not of a batch; each executor runs one for every core."""
    import tracemalloc

    from vectile.llm import weak_labels as L
    from vectile.llm import words as W

    monkeypatch.setattr(W, "_POWERS", {})
    text = " ".join(f"word{k % 977} a{k % 13}" for k in range(250))
    batch = pa.record_batch({"text": [f"{text} {k}" for k in range(3000)]})  # 7 MB
    tracemalloc.start()
    try:
        rows = sum(len(L.features(part.column("text"))[2]) for part in W.pieces(batch, "text"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert rows == 3000 and peak < 100 << 20


def test_training_starts_no_other_workers(spark, docs, monkeypatch):
    """Rows that the driver makes don't go through a second set of Python workers, whether Arrow is on or not."""
    from vectile.llm.weak_labels import train

    def refused(*args, **kwargs):
        raise AssertionError("rows by way of an RDD")

    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    try:
        _, report = train(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"), rounds=1)
    finally:
        spark.conf.set(key, before)
    assert len(report)


def test_statistics_and_list(spark, docs, odd, none):
    from vectile.llm.decision_list import apply_rules

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (docs, odd):
        got = apply_rules(df, labels)[0].select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "doc_id").collect()
        want = []
        for r in df.collect():
            w, t = words(r["text"]), r["text"] or ""
            many = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            hit = {q for k in range(len(w) - 4) if many[tuple(w[k : k + 5])] > 1 for q in range(k, k + 5)}
            lines = [x for x in t.split("\n") if words(x)]
            failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
            want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed, r["doc_id"]))
        assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    judged, rules = apply_rules(none, labels)
    assert judged.count() == 0 and rules == []
    assert apply_rules(odd, labels.limit(0))[0].where("kept = base_failed").count() == 0


def test_list_is_learned():
    """Two faults hidden among clean rows are found, and no clean row is rejected."""
    from vectile.llm.decision_list import FEATURES, learn_list

    rng = np.random.default_rng(5)
    x = {c: rng.random(3000) for c in FEATURES}
    bad = (x["symbol_share"] > 0.9) | ((x["top_share"] > 0.8) & (x["bar_share"] > 0.8))
    rules = learn_list(x, bad)
    on = np.logical_or.reduce([np.logical_and.reduce([c.holds(x) for c in r]) for r in rules])
    assert on[bad].mean() > 0.9 and on[~bad].mean() < 0.01
    assert learn_list(x, np.zeros(3000, dtype=bool)) == [] and learn_list({c: v[:0] for c, v in x.items()}, bad[:0]) == []


# queries -------------------------------------------------------------------------------------------------------------


def test_op1_query_is_its_sql(spark):
    import duckdb

    from vectile.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = collections.Counter(map(tuple, con.execute(ORACLES["op1_substring_dedup"]).fetchall()))
    assert rows_of(QUERIES["op1_substring_dedup"](spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    one = next(iter(want))
    assert len(one[3]) == len(hashlib.sha256(b"").hexdigest())
