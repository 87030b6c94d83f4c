"""The prefix tree, the prefix trie and the spelling variants against brute force."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from vectile.session import scratch_path

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string"
CONTROL = re.compile(r"([<\[])(\\*(?:/?s>|/?INST\]|/?<?/?SYS>>|\|[A-Za-z0-9_]+\|>))")


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def by_conversation(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        convs[c].append(((t is not None, t or 0), digest(r, x), (r, x)))
    return {c: [y[2] for y in sorted(v, key=lambda y: y[:2])] for c, v in convs.items()}


def brute_tree(rows):
    out = []
    for c, s in by_conversation(rows).items():
        loss = "".join(x for r, x in s if r == "assistant")
        role = lambda r: CONTROL.sub(r"\1\\\2", r.replace("\\", "\\\\").replace("\n", "\\n"))
        formatted = "".join(f"<|im_start|>{role(r)}\n{CONTROL.sub(r'\1\\\2', x)}<|im_end|>\n" for r, x in s)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        out.append((c, len(s), sha("".join(f"{r}\n{x}\n" for r, x in s)), len(loss), sha(loss), len(formatted)))
    return collections.Counter(out)


def brute_trie(rows):
    convs = by_conversation([r for r in rows if r[0] is not None])
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members, kids = collections.defaultdict(list), collections.defaultdict(list)
    for c, s in built.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    out, known = [], {}
    for k in sorted(members, key=len, reverse=True):
        leaves = sum(known[x][0] for x in kids[k]) or 1
        saved = sum(known[x][1] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
        known[k] = (leaves, saved)
        ends = hashlib.sha256(",".join(map(str, sorted(c for c in members[k] if len(built[c]) == len(k)))).encode()).hexdigest()
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), leaves, saved, ends))
    return collections.Counter(out)


ODD = [None, "", "zé", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "[INST]<<SYS>> \\ [\\/INST]</s><<\\SYS>>", "漢字 \n\n   ", "<|endoftext|>", "a" * 3000]


def random_rows(seed, many=120):
    rnd = random.Random(seed)
    rows = []
    for c in [*rnd.sample(range(0, 700), many), 100, 200, 300, 5_000_001]:
        for t in range(rnd.choice([1, 1, 2, 3, 5, 9, 12])):
            role = rnd.choice([None, "", "we\\ird\n<|im_end|>"]) if rnd.random() < 0.1 else ("user", "assistant")[t % 2]
            rows.append((c, rnd.choice([t, t, t, None]), role, rnd.choice(ODD) if rnd.random() < 0.3 else "x"))
    return [*rows, rows[0], rows[0]]


@pytest.fixture(scope="module")
def vocabulary():
    from vectile.llm.registered import tokenizer

    return tokenizer("byte_bpe_50k.json")


def counted(df):
    return collections.Counter(tuple(r) for r in df.collect())


def tree_of(spark, df, vocabulary):
    from vectile.llm.chat_tree import read_chat_tree, write_chat_tree

    path = scratch_path(spark, "tree")
    write_chat_tree(df, path, vocabulary)
    return path, counted(read_chat_tree(spark, path, vocabulary))


@pytest.fixture
def small_blocks(monkeypatch):
    from vectile.llm import chat_tree, turn_order

    monkeypatch.setattr(turn_order, "BLOCK_TURNS", 20)  # ranges cross many blocks
    monkeypatch.setattr(chat_tree, "PAGE", 50)


def test_chat_tree(spark, vocabulary, small_blocks):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [(None, 1, "user", "no id"), (None, 0, "assistant", None), *random_rows(1)]
    odd = spark.createDataFrame([(*r, "k", "k") for r in rows], f"{CONV}, digest string, sequence string")  # clashing names
    for df in (table, odd, odd.limit(0)):
        own = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
        path, got = tree_of(spark, df, vocabulary)
        assert got == brute_tree(own)
        turns = sorted(spark.read.parquet(f"{path}/turns").collect(), key=lambda r: r["offset"])
        distinct = {tuple(s[: d + 1]) for s in by_conversation(own).values() for d in range(len(s))}
        assert len(turns) == len(distinct)  # shared turns once
        at, stack = 0, []
        for r in turns:  # depth-first: the parent is the last turn of the depth above
            assert r["offset"] == at and len(r["ids"]) == 4 * r["n_tokens"]
            stack = [*stack[: r["depth"] - 1], r]
            assert [x["depth"] for x in stack] == list(range(1, r["depth"] + 1))
            above = [p for x in stack[:-1] for p in range(x["offset"], x["offset"] + x["n_tokens"])]
            assert [p for x in r["attends"] for p in range(x["start"], x["end"])] == above and r["position"] == len(above)
            at += r["n_tokens"]


def test_control_strings(spark, vocabulary):
    from vectile.llm.chat_tree import escaped, escaped_role, unescaped, unescaped_role

    rnd = random.Random(3)
    parts = ["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "<<SYS>>", "<</SYS>>", "|im_end|>", "|x|>", "a", "\n", "n"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", escaped(df.t).alias("e"), escaped_role(df.t).alias("r")).collect():
        assert unescaped(r["e"]) == r["t"] and unescaped_role(r["r"]) == r["t"] and "\n" not in r["r"]
        assert not re.search(r"</?s>|\[/?INST\]|<<SYS>>|<</SYS>>|<\|\w+\|>", r["e"])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefix_trie(spark, small_blocks, seed):
    from vectile.llm.prefix_trie import prefix_trie, rebuilt

    rows = random_rows(seed) if seed < 3 else [(c, t, "u", "x") for c in range(400) for t in range(c % 7)]  # all alike
    df = spark.createDataFrame([(*r, 1, "k") for r in [*rows, (None, 1, "u", "x")]], f"{CONV}, block int, digest string")
    assert counted(prefix_trie(rebuilt(df))) == brute_trie(rows)


def test_prefix_trie_tables(spark, monkeypatch):
    from vectile.llm import prefix_trie as P

    monkeypatch.setattr(P, "ID_CHUNK", 3)
    df = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert counted(P.prefix_trie(P.rebuilt(df))) == brute_trie([tuple(r) for r in df.collect()])
    assert P.prefix_trie(P.rebuilt(df.limit(0))).count() == 0
    lone = spark.createDataFrame([(101, 0, "u", "x")], CONV)  # turnless where its first turn is to come from an absent one
    assert counted(P.prefix_trie(P.rebuilt(lone))) == brute_trie([(101, 0, "u", "x")])


def test_minima():
    from vectile.llm.turn_order import Minima

    rnd = np.random.default_rng(1)
    for n in (1, 2, 7, 64):
        x = rnd.integers(0, 5, n)
        m = Minima(x)
        at, depth = rnd.integers(0, n, 50), rnd.integers(0, 7, 50)
        assert list(m.reach_right(at, depth)) == [next((p for p in range(a, n) if x[p] < d), n) for a, d in zip(at, depth)]
        assert list(m.reach_left(at, depth)) == [next((p for p in range(a, -1, -1) if x[p] < d), -1) for a, d in zip(at, depth)]
        lo = rnd.integers(0, n, 50)
        hi = lo + 1 + rnd.integers(0, n, 50) % (n - lo)
        assert list(m.least(lo, hi)) == [x[a:b].min() for a, b in zip(lo, hi)]


def brute_near(words):
    gaps, near = collections.defaultdict(set), collections.defaultdict(set)
    for w in words:
        for p in range(len(w)):
            gaps[p, w[:p] + w[p + 1 :]].add(w)
    for (_, d), ws in gaps.items():
        for a in ws:
            near[a] |= ws - {a}
            if d in words:
                near[a].add(d)
                near[d].add(a)
    return near


def brute_variants(counts, ratio=5):
    near, form = brute_near(set(counts)), {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return collections.Counter(out)


def brute_words(rows, every=199, shortest=6, least=5):
    n = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= shortest and k >= least}


def test_spelling_variants(spark, docs, odd, none):
    from vectile.llm.spelling import spelling_variants

    for df, every in ((docs, 199), (docs, 3), (odd, 199)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert counted(spelling_variants(df, slip_every=every)) == brute_variants(brute_words(rows, every))
    assert spelling_variants(none, slip_every=199).count() == 0


@pytest.mark.parametrize("hot", [3, 1000])
def test_near_words_at_every_place(spark, hot, monkeypatch):
    from vectile.llm import spelling

    monkeypatch.setattr(spelling, "HOT", hot)  # crowded chunks are dealt
    rnd = random.Random(7)
    words = {"".join(rnd.choices("abÿ", k=rnd.randint(4, 9))) for _ in range(300)}
    for w in list(words)[:60]:  # an edit at each place
        for p in range(len(w) + 1):
            words |= {w[:p] + "c" + w[p:], w[:p] + "c" + w[p + 1 :], w[:p] + w[p + 1 :]}
    words = {w for w in words if len(w) >= 4}
    df = spark.createDataFrame([(w,) for w in words] + [(None,), (next(iter(words)),)], "word string")
    got = counted(spelling.near_words(df))
    assert got == collections.Counter((a, b) for a, x in brute_near(words).items() for b in x)
    counts = {w: rnd.choice([1, 6, 40, 300]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert counted(spelling.group_variants(table)) == brute_variants(counts)


@pytest.mark.parametrize("name", ["op11_chat_tree", "op12_spelling_variants", "op13_prefix_trie"])
def test_against_sql(spark, name):
    from vectile.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cell = lambda v: None if v is None or v is pd.NA or v != v else v if isinstance(v, str) else float(v)
    rows = lambda d: sorted((tuple(map(cell, r)) for r in d[sorted(d.columns)].itertuples(index=False)), key=str)
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_fits_are_bounded_by_ids(spark):
    """One id on most rows, and labelled: it teaches once."""
    from vectile.llm import decision_list, language_id

    text = lambda k: " ".join(f"word{(k * 7 + j * j) % 97}" for j in range(40))
    rows = [(1, text(k), "en") for k in range(300)] + [(k, text(k), ("en", "de")[k % 2]) for k in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, language_id.F.lit(True))
    assert model.languages == ("de", "en")
    got = language_id.predict(docs, model).collect()
    assert len(got) == len(rows)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 40)], "doc_id long, quality int")
    judged, _ = decision_list.apply_rules(docs, labels)
    assert judged.count() == len(rows)
