"""Numbers of variable length, and each distinct token looked at once."""

import numpy as np

from quantloom.llm.common import text_rows, write_out
from quantloom.llm.postings import coded_blocks, count_tokens, pack, sum_counts, unpack
from quantloom.llm.token_counts import pre_tokens


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    values = np.concatenate(([0, 127, 128, 16383, 16384, 2 ** 21, 2 ** 28, 2 ** 35 - 1], rng.integers(0, 2 ** 30, 500) >> rng.integers(0, 30, 500)))
    at = np.array([0, 3, 4, 100, 507])
    col = pack(values, at)
    back, off = unpack(col)
    assert back.tolist() == values.tolist() and off.tolist() == [*at, len(values)]
    back, off = unpack(col.slice(1, 2))
    assert back.tolist() == values[3:100].tolist() and off.tolist() == [0, 1, 97]


def test_pack_nothing():
    back, off = unpack(pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert len(back) == 0 and off.tolist() == [0]


def test_each_token_once(odd):
    """Many buckets and blocks; a sum of ones is the number of pre-tokens."""
    def once(tokens):
        assert len(set(tokens)) == len(tokens)
        return np.ones(len(tokens), np.int64)
    coded = write_out(coded_blocks(text_rows(odd), pre_tokens, 40, block_bytes=100))
    assert coded.filter("bucket >= 0").groupBy("block", "bucket").count().filter("count > 1").isEmpty()
    out = sum_counts(coded, count_tokens(coded, once)).collect()

    def brute(r):
        text = " " + (r.text or "")
        return r.doc_id, sum(c == " " and (i == 0 or text[i - 1] not in " \u2581") for i, c in enumerate(text)) if r.text else 0
    assert sorted([(r.doc_id, r.total) for r in out], key=repr) == sorted([brute(r) for r in odd.collect()], key=repr)
