"""Filter interaction audit: what each of five filters removes, in every order in which they could be applied.

A document fails a set of the filters, its mask. A part (a source) is told by how many documents have each mask, so
the documents are read once and each part's few cells say the rest. A Gray-code walk visits all 32 subsets of filters
by toggling one at a time: every cell counts its active failures, and leaves or rejoins the running survivors when the
count leaves or reaches zero. The survivors of the 32 states are stored; any step of any order is the difference of two.

The filters: A, fewer than 50 words; B, less than 65 % of the words distinct; C, more than 5 % of the code points A-Z;
D, holds one of ``#$%&*|``; E, the text is that of a smaller id. E follows from digests of the texts: rows alike in
everything but their id are counted before they meet, so a group of copies moves as a few numbers per partition.

Results for odd input: a null text is an empty one (which fails A; without words B holds for no document), a null
source is the part ''. A null id is neither smaller nor larger than any, so it never fails E; of repeated rows none has
a smaller id than the other. A document labelled twice is good or toxic when any label says so, a null label says
nothing. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import write_out

FILTERS = "ABCDE"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first


def text_mask(text: bytes) -> int:
    """Which of A to D a text fails, A as 1, B as 2 and so on."""
    words = text.split()
    points = len(text.translate(None, _FOLLOWING))
    return ((len(words) < 50)
            | (100 * len(set(words)) < 65 * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, _UPPER))) > 5 * points) << 2
            | (len(text.translate(None, _SIGNS)) < len(text)) << 3)


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, part, digest of the text, mask of A to D) for every document; the only step that reads texts."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array([blake2b(t, digest_size=16).digest() for t in texts], pa.binary()),
                 pa.array([text_mask(t) for t in texts], pa.int32())], ["doc_id", "part", "digest", "mask"])
    return rows.mapInArrow(run, "doc_id bigint, part string, digest binary, mask int")


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask of A to E, documents, good, toxic): one row per part and mask that occurs."""
    # written because rows with and without an id take different ways to their labels
    rows = write_out(masks(docs, id_col).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")), "masks")
    known = (labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
             .agg(F.max(F.coalesce((F.col("quality") == 1).cast("int"), F.lit(0))).alias("good"),
                  F.max(F.coalesce((F.col("toxic") == 1).cast("int"), F.lit(0))).alias("bad")))
    none = F.lit(0)
    with_id = rows.filter(F.col("doc_id").isNotNull()).join(known, "doc_id", "left")
    without = rows.filter(F.col("doc_id").isNull()).withColumns({"good": none, "bad": none})
    alike = (with_id.unionByName(without)
             .groupBy("digest", "part", "mask", F.coalesce("good", none).alias("good"), F.coalesce("bad", none).alias("bad"))
             .agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
                  F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")))
    # at most four rows of a text per part are left; the smallest id of all of them passes E
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))
    passing = F.col("n_null") + F.when(F.col("first.doc_id") == F.col("lowest"), F.col("first.n")).otherwise(0)
    told = alike.withColumn("lowest", lowest).select(
        "part", "good", "bad", F.explode(F.array(F.struct("mask", passing.alias("n")),
                                                F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - passing).alias("n")))).alias("c"))
    n = F.col("c.n")
    return (told.groupBy("part", F.col("c.mask").alias("mask"))
            .agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("bad")).alias("toxic")))


def survivors(mask: np.ndarray, counts: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """For every subset of the filters, the columns of ``counts`` summed over the cells that fail none of it."""
    states = np.zeros((1 << filters, counts.shape[1]), np.int64)
    active = np.zeros(len(mask), np.int64)
    running = counts.sum(axis=0)
    states[0] = running
    subset = 0
    for step in range(1, 1 << filters):
        toggled = (step & -step).bit_length() - 1  # the bit in which neighbouring Gray codes differ
        subset ^= 1 << toggled
        hit = mask >> toggled & 1 == 1
        if subset >> toggled & 1:
            running = running - counts[hit & (active == 0)].sum(axis=0)
            active[hit] += 1
        else:
            active[hit] -= 1
            running = running + counts[hit & (active == 0)].sum(axis=0)
        states[subset] = running
    return states


def steps(states: np.ndarray, filters: str = FILTERS) -> pd.DataFrame:
    """Every step of every order of the filters, as differences of two stored states."""
    k = len(filters)
    n = states[:, 0]
    whole = (1 << k) - 1
    shapley = []
    for f in range(k):
        before = np.array([s for s in range(1 << k) if not s >> f & 1])
        times = np.array([factorial(int(s).bit_count()) * factorial(k - 1 - int(s).bit_count()) for s in before])
        shapley.append(int((times * (n[before] - n[before | 1 << f])).sum()))
    rows = []
    for order in permutations(range(k)):
        subset = 0
        for at, f in enumerate(order):
            after = subset | 1 << f
            gone = states[subset] - states[after]
            rows.append(("".join(filters[i] for i in order), at + 1, n[after], gone[0], n[0] - n[1 << f] - gone[0],
                         n[whole ^ 1 << f] - n[whole], gone[1], gone[2], shapley[f]))
            subset = after
    return pd.DataFrame(rows, columns=["filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    def walk(cell: pd.DataFrame) -> pd.DataFrame:  # at most 32 rows
        out = steps(survivors(cell["mask"].to_numpy(np.int64), cell[["n", "good", "toxic"]].to_numpy(np.int64)))
        out.insert(0, "part", cell["part"].iloc[0])
        return out
    return cells(docs, labels).groupBy("part").applyInPandas(
        walk, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
              "toxic_lost long, shapley long")
