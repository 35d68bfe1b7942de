import hashlib
import random
import re
from math import log2

from quantloom.llm import queries, secrets


def brute_base(text):
    kinds = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
              lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    found = [(m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [f"{kinds[k][0]}:{a}:{b}" for a, k, b in sorted(found)]


def brute_entropy(text, scan=secrets.Scan()):
    chars = set("".join(c.characters for c in scan.classes))
    out = []
    for m in re.finditer("[" + re.escape("".join(sorted(chars))) + "]+", text):
        run, w = m[0], scan.window
        if len(run) < w or any(re.fullmatch(a, run) for a in scan.allow):
            continue
        hit = [False] * len(run)
        for i in range(len(run) - w + 1):
            window = run[i:i + w]
            h = -sum(window.count(c) / w * log2(window.count(c) / w) for c in set(window))
            if any(set(window) <= set(c.characters) and h >= c.threshold - 1e-9 for c in scan.classes):
                hit[i:i + w] = [True] * w
        i = 0
        while i < len(run):
            if hit[i]:
                j = i
                while j < len(run) and hit[j]:
                    j += 1
                out.append((m.start() + i, m.start() + j))
                i = j
            i += 1
    return out


def check(rows, out):
    for r, o in zip(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(out, key=lambda r: (r.doc_id is None, r.doc_id))):
        text = r.text or ""
        base = brute_base(text)
        assert o.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert (o.n_assign, o.n_access, o.n_hex) == tuple(sum(b.startswith(k) for b in base) for k in ("assign", "access", "hex"))
        spans = o.spans.split(",") if o.spans else []
        assert [s for s in spans if not s.startswith("entropy")] == base
        assert [(int(a), int(b)) for k, a, b in (s.split(":") for s in spans) if k == "entropy"] == brute_entropy(text)


def test_query_over_whole_table(spark, sf_dir, docs):
    out = queries.op8_secrets(spark, sf_dir).collect()
    assert len(out) == docs.count()
    check(docs.collect(), out)


def test_odd_rows(spark, odd):
    rng = random.Random(1)
    keys = ["".join(rng.choice("ABCDEFabcdef0123456789+/xyzXYZqrst") for _ in range(k)) for k in (19, 20, 21, 40, 400)]
    texts = ["é" + f" {k} " for k in keys] + ["API_KEY : 'abcdefgh' ſecret=abcdefgh token==abcdef", "AKIA" + "Q" * 16 + " AKIA12", "deadbeef" * 4 + "g",
             "123e4567-e89b-12d3-a456-426614174000", "0" * 30, "abcdefghijklmnopqrstuvwxyz0123456789", 'token="secret=abcdef123456"', "0f" * 500 + " Z" * 40]
    more = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    both = odd.dropDuplicates(["doc_id"]).select("doc_id", "text").unionByName(more)
    check(both.collect(), secrets.secret_digest(secrets.find_secrets(both)).collect())
    assert any("entropy" in r.spans for r in secrets.secret_digest(secrets.find_secrets(more)).collect())


def test_masking_keeps_rows_and_columns(odd):
    out = secrets.mask_secrets(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[13] == "<assign> token:abc secret=ab" and text[0] is None
    assert secrets.masked("ab12cd", [(0, 1, 3), (2, 0, 5)]) == "<access>d"


def test_empty_table(odd):
    assert secrets.find_secrets(odd.limit(0)).count() == 0 and secrets.mask_secrets(odd.limit(0)).count() == 0
