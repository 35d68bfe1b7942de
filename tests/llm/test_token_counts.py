import public_tokenizers as P
import sentencepiece

from quantloom.llm import queries
from quantloom.llm.token_counts import token_counts

PATH = P.path("piece_bpe_32k.model")
MODEL = sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(r, limit=4096):
    n = len(MODEL.encode(r.text or ""))
    return r.doc_id, len((r.text or "").encode()), n, n > limit


def test_query_over_whole_table(spark, sf_dir, docs):
    assert sorted(tuple(r) for r in queries.op3_token_counts(spark, sf_dir).collect()) == sorted(expected(r) for r in docs.collect())


def test_odd_rows(odd):
    out = [tuple(r) for r in token_counts(odd, PATH).collect()]
    assert sorted(out, key=repr) == sorted([expected(r) for r in odd.collect()], key=repr)


def test_any_blocks(odd):
    """Blocks and buckets of any size give the same counts."""
    for block, bucket in ((100, 8 << 20), (100, 50), (16 << 20, 50)):
        out = [tuple(r) for r in token_counts(odd, PATH, block_bytes=block, bucket_bytes=bucket).collect()]
        assert sorted(out, key=repr) == sorted([expected(r) for r in odd.collect()], key=repr)


def test_empty_table(odd):
    assert token_counts(odd.limit(0), PATH).count() == 0
