"""Mixing sources to target weights by iterative proportional fitting.

The tokens of each cell (source, language, topic) are summed once. Cell weights are then raked: each dimension in
turn is scaled so that its shares of the weighted tokens are the target's, until no share moves. Cells, shares and
factors are tables; a round is three aggregations and joins over the cells, whose number doesn't depend on how many
documents they hold. Documents are then drawn with probability min(1, c * weight), c solved so that a stated share
of all tokens is drawn: a rare cell with a large weight is kept whole and doesn't thin the others. What such a cell
lacks of its target is reported as ``excess`` (c * weight - 1), as documents are not repeated. The draw is a hash of
the id, so it is the same on every run.

Targets that no weights can meet (one cell holds all tokens of a source and of a language whose shares differ) leave
raking without a limit: the cells concerned report how far their shares are off, and a warning is logged.

Results for odd input: a null in a dimension is a value of its own; a null or empty text has no tokens, so it takes
no part in the sums but has its cell's weight; a document of a cell without tokens has a weight of 1 before scaling;
a null id draws the same number each time; repeated rows are drawn alike; an empty table gives no rows; the other
columns are kept by sample() and ignored by calibrate().
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quantloom.llm.common import discard, write_out

DIMENSIONS = ("source", "lang", "topic")

_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class Raking:
    #: target shares are the shares of tokens to this power, made to add up to 1 (1: as they are, 0: all alike)
    temperature: float = 0.7
    #: stop when no dimension's share is off by more than this
    tolerance: float = 1e-6
    max_rounds: int = 60
    #: share of all tokens that is drawn
    keep: float = 0.6
    salt: str = "mix"


def n_words(text: str) -> Column:
    """Words between the six white-space bytes; 0 for a null."""
    return F.coalesce(F.size(F.filter(F.split(F.col(text), "[ \\t-\\r]+"), lambda w: w != "")), F.lit(0)).cast("bigint")


def topic(text: str, topics: int = 8) -> Column:
    """A stand-in where no topic is given: the first word's hash, one of so many."""
    word = F.lower(F.regexp_extract(F.col(text), "[^ \\t-\\r]+", 0))
    return F.concat(F.lit("t"), F.pmod(F.crc32(F.encode(F.coalesce(word, F.lit("")), "utf-8")), F.lit(topics)).cast("string"))


def cell_tokens(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens): nulls become the empty string with a mark, so they join."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("tokens"))


def tempered_targets(cells: DataFrame, raking: Raking) -> DataFrame:
    """(dim, value, share): target shares for every value of every dimension."""
    out = None
    for d in DIMENSIONS:
        t = cells.groupBy(F.col(d).alias("value")).agg(F.pow(F.sum("tokens"), F.lit(raking.temperature)).alias("x")).filter("x > 0")
        t = t.join(F.broadcast(t.agg(F.sum("x").alias("all"))), F.lit(True)).select(F.lit(d).alias("dim"), "value", (F.col("x") / F.col("all")).alias("share"))
        out = t if out is None else out.unionByName(t)
    return out


def rake(cells: DataFrame, targets: DataFrame, raking: Raking = Raking()) -> DataFrame:
    """(source, lang, topic, tokens, weight, off): the weighted tokens have the target shares in every dimension.

    ``off`` is the largest relative correction that the last round made to a share of the cell: at most the tolerance
    if raking has converged. Targets of a dimension add up to 1 over values with tokens. Cells carry what their values
    are to add up to, and each dimension's step is written to the shared folder, so a plan is one aggregation and one
    join however many dimensions and rounds came before it.
    """
    targets = write_out(targets, "targets")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    for d in DIMENSIONS:
        want = targets.filter(F.col("dim") == d).select(F.col("value").alias("_value"), (F.col("share") * total).alias(f"_want_{d}"))
        cells = cells.join(want, F.col(d) == F.col("_value"), "left").drop("_value")
    now = write_out(cells.withColumn("weight", F.lit(1.0)).withColumn("off", F.lit(0.0)), "cells")
    off = 0.0
    for _ in range(raking.max_rounds if total else 0):
        for d in DIMENSIONS:
            have = now.groupBy(F.col(d).alias("_value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("_have"))
            factor = F.coalesce(F.when(F.col("_have") > 0, F.col(f"_want_{d}") / F.col("_have")), F.lit(1.0))
            gap = F.abs(factor - 1)
            step = now.join(have, F.col(d) == F.col("_value"), "left").withColumns(
                {"off": gap if d == DIMENSIONS[0] else F.greatest("off", gap), "weight": F.col("weight") * factor})
            old, now = now, write_out(step.select(now.columns), "raked")
            discard(old)
        off = now.agg(F.max("off")).first()[0]
        if off <= raking.tolerance:
            break
    if off > raking.tolerance:
        _LOG.warning("raking has not converged after %d rounds: a share is still off by %.3g of its target", raking.max_rounds, off)
    return now.drop(*[f"_want_{d}" for d in DIMENSIONS])


def scale(cells: DataFrame, keep: float) -> float:
    """The c at which probabilities min(1, c * weight) draw the share ``keep`` of all tokens.

    Each step solves for the cells not yet whole; c only grows, so the steps end when no more cells become whole.
    """
    # in tokens of the cells that can be drawn at all
    own = cells.filter("tokens > 0 and weight > 0").select("tokens", "weight")
    budget = keep * (cells.agg(F.sum("tokens")).first()[0] or 0.0)
    c, before = 0.0, -1
    while True:
        whole = F.col("weight") * c >= 1
        n, held, rest = own.agg(F.sum(whole.cast("bigint")), F.sum(F.when(whole, F.col("tokens")).otherwise(0.0)),
                                F.sum(F.when(whole, 0.0).otherwise(F.col("tokens") * F.col("weight")))).first()
        if not rest or n == before:
            return c or 1.0
        c, before = max(c, (budget - held) / rest), n


def draw(id_col: str, salt: str) -> Column:
    """A number in [0, 1) from the id: the first 13 hexadecimal digits of a hash."""
    h = F.md5(F.concat_ws(":", F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def with_dimensions(docs: DataFrame, text_col: str = "text", topic_col: str | Column | None = None) -> DataFrame:
    """source, lang and topic without nulls (a mark stands for null), and n_tokens, beside the own columns.

    ``topic_col`` is a column of the documents or an expression over them; without one, topic() stands in.
    """
    given = topic(text_col) if topic_col is None else F.col(topic_col) if isinstance(topic_col, str) else topic_col
    dims = docs.select("*", F.coalesce(given.cast("string"), F.lit("\0")).alias("_topic"), n_words(text_col).alias("_tokens"))
    return dims.select(*[F.col(c).alias(f"own_{c}") for c in docs.columns], F.coalesce(F.col("source").cast("string"), F.lit("\0")).alias("source"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("\0")).alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"))


def weights(cells: DataFrame, raking: Raking = Raking(), targets: DataFrame | None = None) -> DataFrame:
    """(source, lang, topic, weight, off, probability, excess) per cell."""
    cells = write_out(cells, "cell-tokens")
    raked = rake(cells, tempered_targets(cells, raking) if targets is None else targets, raking)
    wanted = F.col("weight") * F.lit(scale(raked, raking.keep))
    return raked.withColumn("probability", F.least(F.lit(1.0), wanted)).withColumn("excess", wanted - F.col("probability"))


def _with_weights(rows: DataFrame, cells: DataFrame) -> DataFrame:
    cell = cells.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], "weight", "off", "probability", "excess")
    return rows.join(cell, [rows[d] == cell[f"_{d}"] for d in DIMENSIONS], "left").drop(*[f"_{d}" for d in DIMENSIONS])


def calibrate(docs: DataFrame, raking: Raking = Raking(), targets: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
              topic_col: str | Column | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, excess, off, sampled) for every document."""
    rows = with_dimensions(docs, text_col, topic_col).select(F.col(f"own_{id_col}").alias("doc_id"), *DIMENSIONS, "n_tokens")
    rows = write_out(rows, "doc-tokens")
    out = _with_weights(rows, weights(cell_tokens(rows), raking, targets))
    back = [F.when(F.col(c) != "\0", F.col(c)).alias(c) for c in DIMENSIONS]
    return out.select("doc_id", *back, "n_tokens", "weight", "probability", "excess", "off", (draw("doc_id", raking.salt) < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, raking: Raking = Raking(), targets: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
           topic_col: str | Column | None = None) -> DataFrame:
    """The drawn documents with their own columns."""
    rows = with_dimensions(docs, text_col, topic_col)
    out = _with_weights(rows, weights(cell_tokens(rows), raking, targets))
    return out.filter(draw(f"own_{id_col}", raking.salt) < F.col("probability")).select(*[F.col(f"own_{c}").alias(c) for c in docs.columns])
