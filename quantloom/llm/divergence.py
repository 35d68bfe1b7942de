"""Source divergence audit: how far the words of each source of a language lie from those of its other sources.

A term is a run of ASCII letters and bytes beyond ASCII. One ``bytes.translate`` lowers the letters and blanks all that
separates terms, ``bytes.split`` cuts, and a counter per document gives its terms. Counts add up per (lang, source)
in the task, then in a shuffle; a language keeps the terms that occur in at least ``least`` of its documents.

With ``count`` the occurrences of a kept term in a group and ``N`` those of all V kept terms, the group's probability
of the term in units of 1e-9 is p = 1 + floor(1e9 * (count + 1) / (N + V)), for terms it lacks too. Against q, the
other's, a term tells f = floor((p - q)^2 / q). All arithmetic is on integers and exact.

* Part ``pair``: f summed over the kept terms, for each other source of the language.
* Part ``term``: the terms that a source uses more than its language does, by f, the first ``top``.

For the pairs, the terms of a language are dealt to buckets of a bounded number of (term, source) cells; a bucket is one
matrix, in which every source's column is compared to the block of columns it is dealt with. Only sums leave a task.

Results for odd input: a null text, lang or source is an empty one; a group without terms has rows like any other
(with V = 0 its pair values are 0). Repeated rows are a document each. Ids are not looked at. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import write_out

UNIT = 1_000_000_000

_LETTERS = bytes(range(ord("A"), ord("Z") + 1)), bytes(range(ord("a"), ord("z") + 1))
#: Lower letters for upper ones, themselves for lower ones and bytes beyond ASCII, blanks for the rest.
TABLE = bytes(b + 32 if b in _LETTERS[0] else b if b in _LETTERS[1] or b >= 0x80 else 0x20 for b in range(256))

#: (group, term) entries that a task counts before it hands them on
_HELD = 400_000


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def _groups(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n occurrences, docs holding it), summed; a group's row with a null term counts its documents."""
    def run(batches):
        held: dict = defaultdict(lambda: [Counter(), Counter()])
        entries = 0

        def flush():
            rows = [(g, t, n, inside[t]) for g, (total, inside) in held.items() for t, n in total.items()]
            pairs = list(zip(*rows)) if rows else [(), (), (), ()]
            return pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in pairs[0]], pa.string()), pa.array([g[1] for g in pairs[0]], pa.string()),
                 pa.array(pairs[1], pa.binary()).cast(pa.string()), pa.array(pairs[2], pa.int64()), pa.array(pairs[3], pa.int64())],
                ["lang", "source", "term", "n", "docs"])
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(),
                                          batch.column("text").cast(pa.binary()).to_pylist()):
                found = Counter(terms_of(text))
                found[None] = 1
                total, inside = held[lang, source]
                entries -= len(total)
                total.update(found)
                inside.update(found.keys())
                entries += len(total)
                if entries > _HELD:
                    yield flush()
                    held.clear()
                    entries = 0
        if held:
            yield flush()
    return (_groups(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def kept_terms(counts: DataFrame, least: int = 3) -> DataFrame:
    """(lang, source, term, n) of the terms in at least ``least`` documents of the language."""
    # the rows of a term are at most one per source of the language
    inside = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return (counts.filter(F.col("term").isNotNull()).withColumn("_in", inside).filter(F.col("_in") >= least)
            .select("lang", "source", "term", "n"))


def probability(count, total, vocabulary):
    """p of a term, exact for any number of occurrences (without any term kept there is nothing to ask for)."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(F.lit(UNIT)) * (wide(count) + 1), F.greatest(wide(total) + wide(vocabulary), F.lit(1))) + 1


def term_value(p, q):
    """f of a term; p and q are at most 1e9 + 1, so its square fits a long."""
    return F.call_function("div", (p - q) * (p - q), q)


def group_totals(counts: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, source, total) of every group of the table, and (lang, vocabulary, lang_total, sources) of every language."""
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = (counts.filter(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left")
              .withColumn("total", F.coalesce("total", F.lit(0))))
    words = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("lang_total"))
    langs = (groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(words, "lang", "left")
             .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("vocabulary", "lang_total")}))
    return groups, langs


def marked_terms(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int = 200) -> DataFrame:
    """Part ``term``: (lang, source, item, value, rank)."""
    every = F.sum("n").over(Window.partitionBy("lang", "term"))
    told = kept.withColumn("every", every).join(groups, ["lang", "source"]).join(langs, "lang").select(
        "lang", "source", F.col("term").alias("item"), probability(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"),
        probability(F.col("every"), F.col("lang_total"), F.col("vocabulary")).alias("q"))
    # Spark keeps the first ranks of each partition before it shuffles them
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (told.filter("p > q").withColumn("value", term_value(F.col("p"), F.col("q"))).drop("p", "q")
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))


def pair_values(kept: DataFrame, groups: DataFrame, langs: DataFrame, cells: int = 1 << 18, block: int = 128) -> DataFrame:
    """Part ``pair``: (lang, source, item, value) for every ordered pair of sources of a language.

    ``cells`` bounds a bucket's terms times its language's sources, ``block`` the sources that a task compares to all.
    """
    of_lang = Window.partitionBy("lang").orderBy("source")  # one row per source
    zero = probability(F.lit(0), F.col("total"), F.col("vocabulary")).alias("zero")
    buckets = F.ceil(F.col("vocabulary") * F.col("sources") / F.lit(cells)).cast("int")
    known = (groups.withColumn("at", F.row_number().over(of_lang) - 1).join(langs, "lang")
             .withColumns({"buckets": F.greatest(buckets, F.lit(1)), "blocks": F.ceil(F.col("sources") / F.lit(block)).cast("int")}))
    known = write_out(known, "groups")
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    entries = (kept.join(known, ["lang", "source"])
               .select("lang", "term", "at", "blocks", probability(F.col("n"), F.col("total"), F.col("vocabulary")).alias("p"), bucket)
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks"))
    # new names for the columns, so that both sides of the cogroup have their own
    columns = (known.select(*[F.col(c).alias(c) for c in ("lang", "source", "at", "buckets", "blocks")], zero)
               .withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("buckets", "blocks"))

    def compare(key, cell: pd.DataFrame, column: pd.DataFrame) -> pd.DataFrame:
        first = key[2] * block
        column = column.sort_values("at")
        number, names = pd.factorize(cell["term"])
        p = np.repeat(column["zero"].to_numpy(np.int64)[:, None], len(names), axis=1)
        p[cell["at"].to_numpy(), number] = cell["p"].to_numpy(np.int64)
        out = []
        for i in range(first, min(first + block, len(p))):
            gap = p[i] - p
            out.append(pd.DataFrame({"lang": key[0], "source": column["source"].iloc[i], "item": column["source"],
                                     "value": (gap * gap // p).sum(axis=1)}).drop(index=column.index[i]))
        return pd.concat(out)
    keys = ["lang", "bucket", "block"]
    part = entries.groupBy(*keys).cogroup(columns.groupBy(*keys)).applyInPandas(compare, "lang string, source string, item string, value long")
    return part.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence_audit(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of the table."""
    counts = write_out(term_counts(docs), "term-counts")
    kept = write_out(kept_terms(counts, least), "kept-terms")
    groups, langs = group_totals(counts, kept)
    langs = write_out(langs, "langs")
    pairs = pair_values(kept, groups, langs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")  # one row per other source
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return (pairs.withColumn("part", F.lit("pair")).select(out)
            .unionByName(marked_terms(kept, groups, langs, top).withColumn("part", F.lit("term")).select(out)))
