"""The documents of a corpus made ready for training: five stages, each over all that the one before it kept.

Every stage is written to the shared folder and read again. A stage takes the columns of ``documents`` and returns
them; the last returns each document's digest of token ids. An empty table passes through all stages as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import byte_bpe, jaccard, mixing, perplexity, secrets
from quantloom.llm.common import discard, table, write_out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band, each row by its own verdict."""
    # the key is written with the rows, so that it stays theirs when a task runs again
    rows = write_out(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    kept = write_out(perplexity.quality(rows, id_col="_row").filter("kept").select(F.col("doc_id").alias("_row")), "verdicts")
    return rows.join(kept, "_row", "left_semi").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of each group that five-word shingles link at 0.8 or more."""
    return jaccard.first_of_groups(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    masked = secrets.mask_secrets(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the raked shares of sources, languages and topics."""
    return mixing.sample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, as their number and digest, and the digest of what they decode to."""
    return byte_bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("secret scans", mask_secrets),
          ("mixing to target weights", mix_sources), ("byte-level BPE", encode)]

#: Perplexity and raking are iterative estimates over the corpus, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        old, docs = docs, write_out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:  # the first reads what was given
            discard(old)
    return docs
