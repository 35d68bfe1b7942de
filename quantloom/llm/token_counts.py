"""Token counts without token ids.

The piece model never joins a character to a space after it (no piece has a space mark behind another character),
so a text is a row of pre-tokens, each some spaces and what follows up to the next space. Pieces are counted once
per distinct pre-token, joined to the frequencies of pre-tokens per document, and summed (see ``postings``).

Results for odd input: a null or empty text has 0 tokens; a null id gives a row with a null id; repeated rows give
a row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import text_rows, write_out
from quantloom.llm.postings import bucket_count, coded_blocks, count_tokens, sum_counts

_MARK = (0xE2, 0x96, 0x81)  # the space mark in UTF-8


def pre_tokens(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All pre-tokens with the space that stands before every text, and the row of each."""
    size = np.diff(off)
    full = np.flatnonzero(size)
    if not len(full):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    # a space before each text that isn't empty
    out = np.insert(buf, off[full], np.uint8(32))
    begin = off[full] + np.arange(len(full))
    space = out == 32
    first = space.copy()
    first[1:] &= ~space[:-1]
    first[3:] &= ~((out[:-3] == _MARK[0]) & (out[1:-2] == _MARK[1]) & (out[2:-1] == _MARK[2]))
    first[begin] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts, len(out)).astype(np.int64)
    owner = full[np.searchsorted(begin, starts, side="right") - 1]
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(out)]), owner


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(tokens: list[bytes], model_path: str) -> np.ndarray:
    """The number of pieces of each pre-token."""
    model = _model(model_path)
    mark = len(model.encode("a ")) - len(model.encode("a"))  # of a space mark alone, at a text's end
    # the model puts one space mark before what it is given
    text = [t[1:].decode("utf-8", "replace") for t in tokens]
    return np.array([len(x) if t else mark for t, x in zip(text, model.encode(text, num_threads=1))] if text else [], np.int64)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text",
                 block_bytes: int = 16 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every document."""
    rows = text_rows(docs, id_col, text_col)
    coded = write_out(coded_blocks(rows, pre_tokens, bucket_count(rows, bucket_bytes), np.diff, block_bytes), "frequencies")
    counts = count_tokens(coded, partial(piece_counts, model_path=model_path))
    return (sum_counts(coded, counts)
            .select("doc_id", F.col("extra").alias("n_bytes"), F.col("total").alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > limit))
