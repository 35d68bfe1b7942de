import hashlib

import corpus_pipeline
import public_tokenizers as P
import tiktoken
from tiktoken.load import load_tiktoken_bpe

from quantloom.llm import mixing, perplexity, secrets
from quantloom.llm.common import write_out
from test_jaccard import brute


def test_each_stage_on_its_own_input(spark, sf_dir, docs):
    """What each stage keeps follows from its own input; the last is checked against the tokenizer's own library."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(write_out(stage(spark, steps[-1], sf_dir), name.replace(" ", "-")))
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in steps]
    assert all(s.columns == docs.columns for s in steps[:5])
    assert ids[1] == {r.doc_id for r in perplexity.quality(docs).filter("kept").collect()}
    assert ids[2] == {c for _, _, c in brute(steps[1].collect())}
    scan = secrets.EntropyScan(secrets.Scan())
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in (steps[2], steps[3]))
    assert after == {k: secrets.masked(t, secrets.base_spans(t) + scan.spans(t)) for k, t in before.items()}
    assert ids[4] == {r.doc_id for r in mixing.calibrate(steps[3]).filter("sampled").collect()}
    enc = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    assert {r.doc_id: (r.n_tokens, r.decoded_sha256) for r in steps[5].collect()} == {
        k: (len(enc.encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for k, t in texts.items()}


def test_odd_rows(spark, odd, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd.filter("text is null or length(text) < 60000"), sf_dir).count()


def test_empty_table(spark, docs, sf_dir):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
