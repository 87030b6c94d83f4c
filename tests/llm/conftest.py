import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, wordless, short, long, equal and repeated rows, and columns whose names operators use themselves."""
    long = " ".join(f"word{k % 977}" for k in range(60_000))
    texts = [None, "", " \t\n ", "a", "one two", long, "same text here again and again", "same text here again and again", "Ünï çödé\u00a0x\x1cy\u0085z 漢字 … é", "x" * 100_000]
    rows = [(k, t, "en", "s", 0, k, k, "k") for k, t in enumerate(texts)] + [(6, texts[6], "en", "s", 0, 6, 6, "k"), (None, "no id", "en", "s", 0, 1, 1, "k"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key long, bucket long, id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
