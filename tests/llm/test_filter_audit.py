import re
from itertools import permutations

import numpy as np
from pyspark.sql import Row

from quantloom.llm import filter_audit, queries

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    good, toxic = ({r.doc_id for r in labels if r.doc_id is not None and r[c] == 1} for c in ("quality", "toxic"))
    docs = []
    for r in rows:
        text = r.text or ""
        words = SPACE.findall(text)
        docs.append((r.source or "", r.doc_id, {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": r.doc_id is not None and any((o.text or "") == text and o.doc_id is not None and o.doc_id < r.doc_id for o in rows)}))
    out = []
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        rows_of_part, removed_by = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [d for d in left if d[2][f]]
                left = [d for d in left if not d[2][f]]
                removed_by[f] += len(gone)
                rows_of_part.append((f, ["".join(order), i + 1, len(left), len(gone), sum(d[2][f] for d in mine) - len(gone),
                                         sum(d[2][f] and sum(d[2].values()) == 1 for d in mine), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)]))
        out += [(part, *r, removed_by[f]) for f, r in rows_of_part]
    return out


def test_query_over_whole_table(spark, sf_dir, docs):
    out = queries.op13_filter_audit(spark, sf_dir).collect()
    assert sorted(map(tuple, out)) == sorted(brute(docs.collect(), spark.read.parquet(f"{sf_dir}/labels.parquet").collect()))


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, None, 1), (5, 1, None), (6, 1, 1), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    same = [Row(doc_id=i, text=t, source=s) for i, t, s in ((None, "same", "u"), (None, "same", "u"), (40, "same", None), (40, "same", "u"), (41, "same", "u"), (42, None, "v"), (43, "", "v"))]
    rows = odd.unionByName(spark.createDataFrame(same, "doc_id bigint, text string, source string"), allowMissingColumns=True)
    assert sorted(map(tuple, filter_audit.filter_audit(rows, labels).collect())) == sorted(brute(rows.collect(), labels.collect()))
    assert filter_audit.filter_audit(rows.limit(0), labels).count() == 0
    assert filter_audit.filter_audit(rows, labels.limit(0)).count() == 600 * rows.select("source").na.fill("").distinct().count()


def test_walk_against_every_subset():
    rng = np.random.default_rng(2)
    mask, counts = np.arange(32), rng.integers(0, 50, (32, 3))
    states = filter_audit.survivors(mask, counts)
    for subset in range(32):
        assert (states[subset] == counts[mask & subset == 0].sum(axis=0)).all()


def test_mask_by_code_points():
    assert filter_audit.text_mask(("é" * 19 + "A").encode()) == 1  # 5 % of 20 code points, not more
    assert filter_audit.text_mask(("é" * 18 + "A").encode()) == 5
    assert filter_audit.text_mask(b"") == 1
