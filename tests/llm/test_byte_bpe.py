import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from quantloom.llm import byte_bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
MACHINE = byte_bpe.Transducer(RANKS, max_states=3000)
PIECES, DECODER, SPLIT = byte_bpe._Pieces(MACHINE, most=500), byte_bpe.Decoder(RANKS), byte_bpe.Splitter(P.PATTERN)


def ids_of(text):
    return np.frombuffer(b"".join(byte_bpe.encode_text(text, PIECES, SPLIT, part=7)), "<u4").tolist()


@given(st.text(max_size=200))
@settings(max_examples=400, deadline=None)
def test_any_text_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


@given(st.binary(min_size=1, max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_piece_of_bytes(piece):
    assert MACHINE.encode(piece) == LIBRARY._encode_single_piece(piece)


@pytest.mark.parametrize("piece", [b"a" * 20_000, b"ab" * 9_000, b"= " * 50, b"\xff" * 500, b"the" * 3000])
def test_long_pieces_keep_a_bounded_state(piece):
    assert MACHINE.encode(piece) == LIBRARY._encode_single_piece(piece)
    assert max(len(c) for entries, _ in MACHINE.states for _, c in entries) < 64


@given(st.binary(max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_decoding_in_chunks(data, size):
    ids = np.array([RANKS[bytes([b])] for b in data], np.int64)
    text = "".join(DECODER.feed(ids[i:i + size]) for i in range(0, len(ids), size)) + DECODER.close()
    assert text == data.decode("utf-8", "replace")


def test_decoding_tokens_in_chunks():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aé中😀 ñß\n") for _ in range(50))
        ids = np.array(LIBRARY.encode_ordinary(text))
        assert "".join(DECODER.feed(ids[i:i + 3]) for i in range(0, len(ids), 3)) + DECODER.close() == text


def expected(doc_id, text):
    text = text or ""
    ids = LIBRARY.encode_ordinary(text)
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


def test_query_over_whole_table(spark, sf_dir, docs):
    out = [tuple(r)[:4] for r in queries.op2_byte_bpe(spark, sf_dir).collect()]
    assert sorted(out) == sorted(expected(r.doc_id, r.text) for r in docs.collect())


def test_odd_rows(odd):
    out = byte_bpe.bpe_round_trip(odd, PATH, P.PATTERN, keep=("ids", "decoded")).collect()
    assert sorted([tuple(r)[:4] for r in out], key=repr) == sorted([expected(r.doc_id, r.text) for r in odd.collect()], key=repr)
    assert all(r.same and r.ids == LIBRARY.encode_ordinary(r.decoded) for r in out)


def test_empty_table(odd):
    assert byte_bpe.bpe_round_trip(odd.limit(0), PATH, P.PATTERN).count() == 0
