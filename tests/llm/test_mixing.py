import logging

import pytest
from pyspark.sql import functions as F

from quantloom.llm import mixing


@pytest.fixture(scope="module")
def even(spark):
    """1,000 documents of 50 words in 3 sources and 2 languages."""
    rows = [(i, f"w{i % 7} " + "x " * 49, ("a", "a", "a", "b", "b", "c")[i % 6], "en" if i % 5 else "de") for i in range(1000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")


def kept(df):
    r = df.agg(F.sum(F.col("n_tokens") * F.col("probability")), F.sum("n_tokens"), F.max("off")).first()
    return r[0] / r[1], r[2]


@pytest.mark.parametrize("source, lang", [("stray", "en"), (None, "en"), ("a", "xx")])
def test_one_stray_document_does_not_thin_the_corpus(spark, even, source, lang):
    stray = spark.createDataFrame([(5000, "x " * 50, source, lang)], even.schema)
    out = mixing.calibrate(even.unionByName(stray)).cache()
    share, off = kept(out)
    assert abs(share - mixing.Raking().keep) < 1e-6 and off <= mixing.Raking().tolerance
    row = out.filter("doc_id = 5000").first()
    assert row.probability == 1 and row.excess > 0 and row.sampled and row.source == source
    # cells that are not whole keep the ratio of their weights
    free = out.filter("probability < 1").select((F.col("probability") / F.col("weight")).alias("c")).agg(F.min("c"), F.max("c")).first()
    assert abs(free[0] / free[1] - 1) < 1e-9


def test_unmet_targets_are_reported(spark, even, caplog):
    stray = spark.createDataFrame([(5000, "x " * 50, "stray", "xx")], even.schema)
    with caplog.at_level(logging.WARNING):
        out = mixing.calibrate(even.unionByName(stray), mixing.Raking(max_rounds=8)).cache()
    assert "not converged" in caplog.text
    assert out.filter("doc_id = 5000").first().off > 0.01 and abs(kept(out)[0] - 0.6) < 1e-6


def test_topic_of_the_caller(even):
    by_column = mixing.calibrate(even.withColumn("subject", F.when(F.col("doc_id") < 300, "law")), topic_col="subject").collect()
    by_rule = mixing.calibrate(even, topic_col=F.when(F.col("doc_id") < 300, "law")).collect()
    assert {(r.doc_id < 300, r.topic) for r in by_column} == {(True, "law"), (False, None)}
    assert sorted(by_column) == sorted(by_rule)


def test_sample_draws_what_calibrate_reports(even):
    assert {r.doc_id for r in mixing.sample(even).collect()} == {r.doc_id for r in mixing.calibrate(even).filter("sampled").collect()}
