"""The pipeline's stages on the smallest tables and on odd rows."""

import re

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline as P
    from vectile.session import cut

    docs = P.table(spark, SF, "documents")
    whole, seen = docs.toPandas().set_index("doc_id"), []
    for _, stage in P.STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, SF))
        assert docs.columns == before.columns
        seen.append(docs.toPandas().set_index("doc_id"))
    assert all(set(b.index) <= set(a.index) for a, b in zip([whole, *seen], seen))
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id")
    clean = labels[(labels["quality"] == 1) & (labels["toxic"] == 0)].index
    assert len(set(clean) & set(seen[0].index)) >= 0.95 * len(set(clean) & set(whole.index))
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(t in " ".join(x.split()) for x in seen[2]["text"] for t in items)
    assert len(seen[3]) == len(seen[2]) and (seen[3]["n_chars"] == seen[3]["text"].str.len()).all()
    mails = {m for x in seen[2]["text"] for m in re.findall(r"[\w.]+@[\w.]+\w", x)}
    assert not any(m in x for x in seen[3]["text"] for m in mails)
    packed = P.packing(spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == set(seen[3].index)


def test_odd_rows(spark, odd, none):
    import corpus_pipeline as P

    odd = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in P.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, none.select(*odd.columns), SF).count() == 0
    assert P.personal_data(spark, odd, SF).count() == odd.count()


def test_texts_go_to_python_in_small_batches(spark, none):
    import pyarrow as pa
    from pyspark.sql import functions as F

    import corpus_pipeline as P

    def sizes(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array([b.nbytes], pa.int64())})

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, docs = spark.conf.get(key), none.select("doc_id", "text", "lang", "source", "n_chars")
    texts = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 4000).alias("text"))
    try:
        for stage in (P.quality, P.near_copies, P.packing):
            spark.conf.set(key, str(64 << 20))
            stage(spark, docs, SF)
            got = [r["n"] for r in texts.mapInArrow(sizes, "n long").collect()]
            assert max(got) < 6 << 20 and sum(got) >= 16_000_000
    finally:
        spark.conf.set(key, before)


def brute_groups(texts, size=5, percent=80):
    """Least place of each text's group, linked by distinct word runs."""
    split = [re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    split = [tuple(x for x in re.split(r"[\x20\x09-\x0D]+", t) if x) for t in split]
    runs = [{w[k : k + size] for k in range(max(len(w) - size, 0) + 1)} if w else set() for w in split]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    at = {}
    for k, r in enumerate(runs):
        for x in r:
            at.setdefault(x, []).append(k)
    for i, j in {(i, j) for k in at.values() for i in k for j in k if i < j}:
        common = len(runs[i] & runs[j])
        if 100 * common >= percent * (len(runs[i]) + len(runs[j]) - common):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(k) for k in range(len(texts))]


def test_near_copies_are_groups_at_five_words(spark):
    import corpus_pipeline as P

    docs = P.table(spark, SF.replace("0.001", "0.01"), "documents")
    rows = docs.toPandas().sort_values("doc_id")
    ids = rows["doc_id"].tolist()
    stay = {ids[k] for k, r in enumerate(brute_groups(rows["text"].tolist())) if k == r}
    assert {r["doc_id"] for r in P.near_copies(spark, docs, SF).select("doc_id").collect()} == stay
    text = " ".join(f"w{k}" for k in range(100))
    made = spark.createDataFrame([(1, text), (2, text + " " + " ".join(f"v{k}" for k in range(20)))], "doc_id long, text string")
    assert [r["doc_id"] for r in P.near_copies(spark, made, SF).collect()] == [1]


def test_near_copies_of_rows(spark):
    import corpus_pipeline as P

    text = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcd"]
    rows = [(1, text[0]), (2, text[0]), (2, text[1]), (3, text[2]), (3, text[2]), (None, text[2]), (None, text[3]), (None, text[3]), (None, text[3]), (4, ""), (4, None)]
    left = P.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF)
    got = sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect())
    assert got == sorted([(1, text[0]), (2, text[1]), (3, text[2]), (0, text[3]), (4, ""), (4, "")])
