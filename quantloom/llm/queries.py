"""Registered queries of the operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.llm import brown, byte_bpe, chroma, divergence, filter_audit, gam, jaccard, mixing, perplexity, repeats, secrets, token_counts, warc
from quantloom.llm.common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived with a dictionary and read back."""
    folder, archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return byte_bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated weight and whether it is drawn."""
    return mixing.calibrate(table(spark, sf_dir, "documents"))


def op5_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and perplexity bands for every document."""
    return perplexity.quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("perplexity", 6).alias("perplexity"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size and the component that links of 0.8 or more put it in."""
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text's UTF-8 bytes as 8-bit samples, aligned to those of ids divisible by 20."""
    recordings = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.encode("text", "utf-8").alias("pcm"))
    return chroma.chroma_report(recordings, F.col("id") % 20 == 0, dtype="u1").withColumnRenamed("id", "doc_id")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every text."""
    return secrets.secret_digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text without the strings that stand more than once."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op10_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and class-model scores of every text."""
    return brown.brown_scores(table(spark, sf_dir, "documents"))


def op11_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's quality by an additive model of the labels."""
    return gam.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of a language by the distance of their terms, and the terms that mark each."""
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every order of five filters, per source."""
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_byte_bpe, op3_token_counts, op4_mixing, op5_perplexity, op6_jaccard, op7_chroma, op8_secrets, op9_repeats,
                                   op10_brown, op11_gam, op12_divergence, op13_filter_audit)}

SQL: dict[str, str] = {
    "op12_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS doc FROM documents),
t AS (SELECT lang, source, doc, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
vocabulary AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN vocabulary USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM vocabulary GROUP BY lang),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
      LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n,
             1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v))::BIGINT AS p
      FROM g JOIN vocabulary USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(n) AS total FROM c GROUP BY lang) USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term
                          WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
WHERE part = 'pair' OR rank <= 200""",
    "op13_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
             + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
             + 16 * coalesce(doc_id > first, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
      FROM w LEFT JOIN l USING (doc_id)),
cell AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
           FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[1:step])::INT AS after FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
rows AS (SELECT part, filter_order, step, any_value(bit) AS bit,
                sum(n) FILTER (mask & after = 0) AS kept, sum(n) FILTER (mask & bit > 0 AND mask & (after - bit) = 0) AS removed,
                sum(n) FILTER (mask & bit > 0 AND mask & (after - bit) > 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
                sum(good) FILTER (mask & bit > 0 AND mask & (after - bit) = 0) AS good_lost, sum(toxic) FILTER (mask & bit > 0 AND mask & (after - bit) = 0) AS toxic_lost
         FROM steps, cell GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley
FROM rows""",
}
