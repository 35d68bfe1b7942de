import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import gam, queries


def test_query_tells_held_out_documents_apart(spark, sf_dir, docs):
    out = {r.doc_id: r for r in queries.op11_gam(spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert len(out) == spark.read.parquet("/root/testdata/sf0.01/documents.parquet").count()
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    unseen = [(out[r.doc_id].score, r.quality) for r in labels if out[r.doc_id].held_out]
    good, bad = [s for s, q in unseen if q], [s for s, q in unseen if not q]
    above = sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad))
    assert above > 0.97, above


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0)).astype(float)
    m = gam.fit_model(x, y, np.ones(len(y)), gam.Fit(pairs=2, rounds=30, pair_rounds=80))
    assert {(a, b) for a, b, _ in m.pairs} >= {(0, 1)}  # the joint cut is found although neither feature helps alone
    new = rng.normal(size=(500, 3))
    want = []
    for row in new:
        s = m.start
        for i, (cuts, table) in enumerate(zip(m.cuts, m.tables)):
            s += table[sum(row[i] >= c for c in cuts)]
        for a, b, table in m.pairs:
            s += table[sum(row[a] >= c for c in m.pair_cuts[a]), sum(row[b] >= c for c in m.pair_cuts[b])]
        want.append(1 / (1 + np.exp(-s)))
    assert np.allclose(m.score(new), want, atol=1e-12)
    assert ((m.score(new) > 0.5) == ((new[:, 0] > 0.5) ^ (new[:, 1] > 0))).mean() > 0.9


def test_best_cut_against_every_cut():
    rng = np.random.default_rng(1)
    fit = gam.Fit(leaves=2)
    for shape in ((9, 1), (5, 7), (1, 1)):
        g, h = rng.normal(size=shape), rng.uniform(1, 2, shape)
        loss = lambda a, b: -(a.sum() ** 2) / (b.sum() + fit.ridge)
        every = [loss(g, h)] + [loss(*(np.split(v, [c], axis)[0] for v in (g, h))) + loss(*(np.split(v, [c], axis)[1] for v in (g, h)))
                                for axis in range(2) for c in range(1, shape[axis])]
        tree = gam.shallow_tree(g, h, fit)
        got = (2 * tree * g).sum() + sum((h[tree == v].sum() + fit.ridge) * v * v for v in np.unique(tree))
        assert got == pytest.approx(min(every))


def test_features_ignore_nothing_and_bear_anything(odd):
    for text in (b"", b" \n", b"a", "é\x00 ▁".encode(), b"x " * 100_000):
        v = gam.features_of(text)
        assert len(v) == len(gam.FEATURES) and np.isfinite(v).all()
    assert gam.features_of(b"a b") != gam.features_of(b"a b" + b" a b" * 5000 + b" #")  # a text's end counts


def test_odd_rows_and_labels(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 0, "x"), (3, 0, 0, "x"), (7, 0, 1, None), (8, 1, 0, None), (12, None, 0, None), (None, 1, 1, None)],
                                   "doc_id bigint, quality int, toxic int, text string")
    out = gam.quality_scores(odd, labels).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [True]
    assert len({r.score for r in out if r.doc_id in (0, 1)}) == 1  # a null text is an empty one
    for one in (labels.filter("quality = 1"), labels.limit(0)):
        scores = {r.score for r in gam.quality_scores(odd, one).collect()}
        assert len(scores) == 1 and scores.pop() >= 0.5
    assert gam.quality_scores(odd.limit(0), labels).count() == 0


def test_sample_is_bounded_and_keeps_class_shares(spark, docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 10 > 0).cast("int").alias("quality"))
    x, y, weight = gam.training_sample(docs, labels, gam.Fit(per_class=15))
    n = docs.count()
    assert len(x) == 30 and y.sum() == 15
    assert weight[y == 1].sum() / weight.sum() == pytest.approx(docs.filter("doc_id % 10 > 0").count() / n)
