import random

import pytest
from pyspark.sql import Row


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and extra columns with clashing names."""
    rng = random.Random(5)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(30_000))
    texts = [None, "", "   \n\t ", "one", "one", long, long, "Straße naïve 中文 😀 ▁mark  two   spaces \x00 nul\r\n", "a" * 50_000, "x\n" * 300,
             "the same line\n" * 40, "lower UPPER " * 30, "▁ ▁▁ lead", "password = hunter2hunter2 token:abc secret=ab"]
    rows = [Row(doc_id=i, text=t, lang=None if i % 5 == 0 else "en", source=None if i % 4 == 0 else "s", n_chars=None, token="clash", row_key=1,
                lang_key=2, weight=3.0, block=4, n=5, cell=6, value="v") for i, t in enumerate(texts)]
    rows += [rows[5], rows[3], Row(**{**rows[7].asDict(), "doc_id": None})]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, row_key int, lang_key int, "
                                       "weight double, block int, n int, cell int, value string")
