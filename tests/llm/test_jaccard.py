import re
from itertools import combinations

from quantloom.llm import jaccard, queries
from quantloom.llm.jaccard import Join, first_of_groups, jaccard_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def brute(rows):
    """(id, size, component) by all pairs."""
    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    root = list(range(len(sets)))
    for (i, (_, a)), (j, (_, b)) in combinations(enumerate(sets), 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b) and root[i] != root[j]:
            old, new = root[j], root[i]
            root = [new if x == old else x for x in root]
    out = []
    for i, (k, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if root[j] == root[i] and sets[j][0] is not None]
        out.append((k, len(s), min(ids, default=None) if s else k))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_over_whole_table(spark, sf_dir, docs):
    assert got(queries.op6_jaccard(spark, sf_dir)) == brute(docs.collect())


def test_odd_rows(odd):
    assert got(jaccard_components(odd)) == brute(odd.collect())


def test_empty_table(odd):
    assert jaccard_components(odd.limit(0)).count() == 0


def test_chains_need_recursion(spark):
    """Near copies that change word by word: small leaves send them through every kind of round."""
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[:k % 40] + [f"x{k}"] + base[k % 40 + 1:])) for k in range(120)]
    rows += [(1000 + k, " ".join(base[k:] + [f"y{k}{j}" for j in range(k)])) for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(df.collect())
    for join in (Join(leaf=3, members=5, max_rounds=2), Join(leaf=4, members=7, max_rounds=0)):
        assert got(jaccard_components(df, join)) == want


def test_one_of_each_group_stays(odd):
    out = first_of_groups(odd)
    assert out.columns == odd.columns
    comps = {c for k, _, c in brute(odd.collect()) if k is not None}
    assert {r.doc_id for r in out.collect()} - {None} == comps
