import pytest
from pyspark.sql import functions as F

from quantloom.llm import perplexity as P
from test_perplexity import Brute


@pytest.mark.parametrize("file_entries, held_entries", [(1 << 20, 1 << 24), (500, 1000)])
def test_no_two_ngrams_share_an_entry(docs, file_entries, held_entries):
    """Whatever the hash's bits, and with many small files of which few are held."""
    some = docs.limit(20)
    rows = some.collect()
    rules = P.Rules(order=3, hash_bits=8, file_entries=file_entries, held_entries=held_entries)
    out = {r.doc_id: r.log_ppl for r in P.quality(some, rules).collect()}
    brute = {x: Brute([r.text for r in rows if r.lang == x], 3) for x in {r.lang for r in rows}}
    assert all(abs(out[r.doc_id] - brute[r.lang].log_ppl(r.text)) < 1e-5 for r in rows)


def test_text_that_fails_the_base_rules_is_not_learnt(spark, docs):
    some = docs.select("doc_id", "lang", "text").limit(30)
    junk = spark.createDataFrame([(10_000 + i, "en", "zq xj " * 500) for i in range(3)], some.schema)
    before, after = ({r.doc_id: r.log_ppl for r in P.quality(x).collect()} for x in (some, some.unionByName(junk)))
    assert all(abs(after[i] - before[i]) < 1e-9 for i in before)


def test_bands_reject_junk_rather_than_clean_text(spark):
    at = "/root/testdata/sf0.01"
    out = P.quality(spark.read.parquet(f"{at}/documents.parquet")).filter("not base_failed")
    by = {r.quality: r for r in out.join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").groupBy("quality").agg(
        F.avg((~F.col("kept")).cast("int")).alias("share"), F.count(F.lit(1)).alias("n")).collect()}
    assert by[0].n >= 10 and by[0].share > 0.2 and by[1].share < 0.03
    assert out.filter("log_ppl < low").count() and out.filter("log_ppl > high").count()
