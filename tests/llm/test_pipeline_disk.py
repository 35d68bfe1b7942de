import os

import corpus_pipeline

from quantloom.llm import jaccard, perplexity
from quantloom.llm.common import shared_dir


def left_by(spark, run):
    """Names of the tables that a run leaves in the shared folder."""
    folder = shared_dir(spark).removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    run()
    return {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}


def test_quality_keeps_only_its_scores(spark, docs):
    """Before, the texts, n-grams and model stayed on disk through all later stages."""
    assert left_by(spark, lambda: perplexity.quality(docs).count()) == {"scored"}


def test_results_of_stages_go_when_the_next_has_read_them(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(f"s{k}", lambda s, d, _: d.limit(9)) for k in range(3)])
    rows = []
    assert left_by(spark, lambda: rows.append(corpus_pipeline.run(spark, sf_dir).count())) == {"s2"}
    assert rows == [9]


def test_texts_cross_the_network_once_to_the_first_of_groups(spark):
    """Before, they also went to their component, to be grouped where they have no word."""
    rows = [(k, f"a{k} b{k} c{k} d{k} e{k}") for k in range(4)] + [(7, " \t"), (7, " \t"), (7, None), (None, ""), (None, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = jaccard.first_of_groups(df)
    assert out.count() == 8  # repeats of one without a word are one, those without an id all stay
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join" in x]
    assert len(joins) == 2 and sum("LeftSemi" in x for x in joins) == 1, plan
