import corpus_pipeline
from quantloom.llm import jaccard

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(docs, n):
    """Texts that pass the quality rules, no two of one group."""
    return [r.text for r in jaccard.first_of_groups(docs.filter("lang = 'en' and length(text) between 500 and 5000")).orderBy("doc_id").limit(n).collect()]


def test_rows_with_null_or_shared_ids_stay_by_their_text(spark, docs):
    a, b, c, d, e = prose(docs, 5)
    rows = [(None, a), (None, b), (7, c), (7, d), (1, e), (None, e), (9, e), (None, b), (3, ""), (3, ""), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    out = sorted(((r.doc_id, r.text) for r in jaccard.first_of_groups(df).collect()), key=repr)
    assert out == sorted([(None, a), (None, b), (7, c), (7, d), (1, e), (3, ""), (None, None), (None, "")], key=repr)


def test_a_bad_row_does_not_remove_others_of_its_id(spark, docs, sf_dir):
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir).filter("lang = 'en'").orderBy("doc_id").limit(2).collect()
    ids = [r.doc_id for r in one]
    rest = docs.filter(~docs.doc_id.isin(ids)).select("doc_id", "text", "lang", "source", docs.n_chars.cast("bigint").alias("n_chars"))
    more = [(None, r.text, r.lang, r.source, 1) for r in one] + [(None, "too short", "en", "s", 1)]
    out = corpus_pipeline.quality_rules(spark, rest.unionByName(spark.createDataFrame(more, SCHEMA)), sf_dir)
    assert {r.text for r in out.filter("doc_id is null").collect()} == {r.text for r in one}
