"""Quality rules by n-gram perplexity.

Per language, a modified Kneser-Ney model of character 5-grams is counted by Spark over the documents that pass the
base rules: whole counts for 5-grams, numbers of distinct left neighbours for shorter ones, three discounts per
language and order. The model holds discounted probabilities and back-off weights by the whole packed n-gram, so no
two n-grams share an entry, whatever the corpus holds. It is cut into sorted files of bounded size; a task looks up
the distinct n-grams of its texts by search and holds so many files at a time as ``held_entries`` allows.

A document is rejected if its perplexity per character is outside its language's band: the median of the
language's logarithms, minus and plus so many median absolute deviations (``CORPUS``), from counts of
values rounded to 1/10000. Documents that fail the base rules take no part in the band.

Results for odd input: a null or empty text has no words, perplexity 1 and fails the base rules; a null language
is a language of its own; a null id gives a row with a null id; repeated rows give a row each and count each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import OrderedDict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.llm.common import discard, mix64, prefix_hash, run_starts, slices, span_hash, store, text_buffer, words_in, write_out

_BITS = 12  # of a character in a packed n-gram
_FOLD = 1 << (_BITS - 1)


@dataclass(frozen=True)
class Rules:
    order: int = 5
    #: without effect: n-grams are told apart by all their bits
    hash_bits: int = 22
    min_words: int = 20
    max_repeat_percent: int = 30
    repeat_window: int = 8
    #: median absolute deviations below and above the median
    below: float = 12.0
    above: float = 12.0
    #: least width of one deviation, in log10 per character
    least: float = 0.01
    slice_bytes: int = 1 << 20
    #: count the model over documents that fail the base rules, too
    learn_failed: bool = True
    #: entries of a file of the model, about, and entries that a task holds
    file_entries: int = 1 << 20
    held_entries: int = 1 << 24


#: The rules of the query and the pipeline. By the labels of sf0.1 the band rejects 40 of 301 documents of quality 0 that
#: pass the base rules, 11 of them below and 29 above, and 22 of 3,302 of quality 1, 17 and 5.
CORPUS = Rules(below=7.0, above=4.0, learn_failed=False)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters as numbers below 2**12 (letters A-Z lower-cased, high code points folded) and where texts begin."""
    size = np.array([0] + [len(t) for t in texts], np.int64)
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    c = np.where(c < _FOLD, c, _FOLD + c % _FOLD)
    upper = (c >= 65) & (c <= 90)
    c[upper] += 32
    return c, np.cumsum(size)


def packed(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each character, start marks (0) before each text, and where texts begin."""
    c, off = symbols(texts)
    place = np.arange(len(c)) - np.repeat(off[:-1], np.diff(off))
    key = c.copy()
    for j in range(1, order):
        key[j:] |= np.where(place[j:] >= j, c[:-j], 0) << (_BITS * j)
    return key, off


def _lang_number(names: list[str | None]) -> np.ndarray:
    return mix64(np.array([zlib.crc32((x or "").encode()) + (x is None) * (1 << 33) for x in names], np.uint64))


def count_ngrams(docs: DataFrame, rules: Rules) -> DataFrame:
    """(lang, lang_key, key, n): how often each packed n-gram of the highest order occurs in each language."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", rules.slice_bytes):
                names = part.column("lang").to_pylist()
                texts = part.column("text").to_pylist()
                if not rules.learn_failed:
                    learnt = [not x for x in part.column("base_failed").to_pylist()]
                    texts, names = ([x for x, ok in zip(v, learnt) if ok] for v in (texts, names))
                for name in dict.fromkeys(names):
                    key, _ = packed([t for t, x in zip(texts, names) if x == name], rules.order)
                    key.sort()
                    at = run_starts(key)
                    n = np.diff(np.append(at, len(key)))
                    number = int(_lang_number([name])[0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(np.full(len(at), number)),
                                                      pa.array(key[at]), pa.array(n.astype(np.int64))], ["lang", "lang_key", "key", "n"])
    rows = docs.mapInArrow(run, "lang string, lang_key bigint, key bigint, n bigint")
    return rows.groupBy("lang", "lang_key", "key").agg(F.sum("n").alias("n"))


def _discounts(grams: DataFrame) -> DataFrame:
    """Per language: what modified Kneser-Ney takes from counts of 1, 2 and more."""
    many = grams.groupBy("lang_key").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.col("n1") / F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") + 2 * F.col("n2"))

    def d(k: int, usual: float):
        value = k - (k + 1) * y * F.col(f"n{k + 1}") / F.when(F.col(f"n{k}") > 0, F.col(f"n{k}"))
        # too few n-grams to estimate from: the usual share
        return F.when(value.between(0.01, float(k)), value).otherwise(F.lit(usual))
    return many.select("lang_key", d(1, 0.5).alias("d1"), d(2, 1.0).alias("d2"), d(3, 1.5).alias("d3"))


def build_model(ngrams: DataFrame, rules: Rules) -> DataFrame:
    """(kind, n, lang_key, x, value): kind 0 discounted probability of an n-gram, 1 back-off weight of its context.

    Files hold ranges of (kind, n, lang_key, x), sorted.
    """
    parts, grams = [], ngrams
    for n in range(rules.order, 0, -1):
        context = grams.select("*", F.shiftright("key", _BITS).alias("context")) if n > 1 else grams.select("*", F.lit(0).cast("bigint").alias("context"))
        with_d = context.join(F.broadcast(_discounts(grams)), "lang_key")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        with_d = with_d.withColumn("d", d)
        totals = with_d.groupBy("lang_key", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("taken"))
        seen = with_d.join(totals, ["lang_key", "context"]).select(F.lit(0).alias("kind"), "lang_key", F.col("key").alias("x"), ((F.col("n") - F.col("d")) / F.col("total")).alias("value"))
        rest = totals.select(F.lit(1).alias("kind"), "lang_key", F.col("context").alias("x"), (F.col("taken") / F.col("total")).alias("value"))
        parts.append(seen.unionByName(rest).select("kind", F.lit(n).alias("n"), "lang_key", "x", "value"))
        if n > 1:
            # a shorter n-gram counts the distinct characters before it
            grams = grams.groupBy("lang", "lang_key", F.col("key").bitwiseAND((1 << (_BITS * (n - 1))) - 1).alias("key")).agg(F.count(F.lit(1)).alias("n"))

    model = parts[0]
    for p in parts[1:]:
        model = model.unionByName(p)
    # shorter n-grams and contexts are together about as many again
    files = max(4, -(-2 * ngrams.count() // rules.file_entries))
    order = ("kind", "n", "lang_key", "x")
    return model.withColumn("value", F.col("value").cast("float")).repartitionByRange(files, *order).sortWithinPartitions(*order)


def model_files(model: DataFrame) -> tuple[tuple, ...]:
    """(last entry, first entry, file) of the model's files, in their order; as many as the model's size asks for."""
    entry = F.struct("kind", "n", "lang_key", "x")
    found = model.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.max(entry).alias("last"), F.min(entry).alias("first")).collect()
    return tuple(sorted((tuple(r["last"]), tuple(r["first"]), r["file"]) for r in found))


class Model:
    """Lookups in the files of a model, of which the last used are held."""

    def __init__(self, path: str, files: tuple[tuple, ...], held_entries: int):
        self.fs, self.at = store(path)
        self.files, self.lasts, self.most = files, [f[0] for f in files], held_entries
        self.held: OrderedDict[str, dict] = OrderedDict()
        self.size: dict[str, int] = {}

    def _file(self, name: str) -> dict:
        """(kind, n, lang_key) -> sorted n-grams and their values."""
        if name in self.held:
            self.held.move_to_end(name)
            return self.held[name]
        t = pyarrow.parquet.read_table(f"{self.at}/{name}", filesystem=self.fs, partitioning=None)
        kind, n, lang, x, value = (np.asarray(t.column(c)) for c in ("kind", "n", "lang_key", "x", "value"))
        new = np.flatnonzero((np.diff(kind) != 0) | (np.diff(n) != 0) | (np.diff(lang) != 0)) + 1
        edge = [0, *new.tolist(), len(x)]
        self.size[name] = len(x)
        while self.held and sum(self.size[f] for f in self.held) + len(x) > self.most:
            self.held.popitem(last=False)
        self.held[name] = {(int(kind[a]), int(n[a]), int(lang[a])): (x[a:b], value[a:b]) for a, b in zip(edge, edge[1:]) if b > a}
        return self.held[name]

    def find(self, kind: int, n: int, lang: int, keys: np.ndarray, default: float) -> np.ndarray:
        """The values of sorted n-grams of a language, ``default`` where there is none."""
        out = np.full(len(keys), default, np.float64)
        own = (kind, n, lang)
        for last, first, name in self.files[bisect_left(self.lasts, (*own, int(keys[0]))):]:
            if first > (*own, int(keys[-1])):
                break
            if own in (held := self._file(name)):
                x, value = held[own]
                a, b = np.searchsorted(keys, x[0]), np.searchsorted(keys, x[-1], side="right")
                place = np.searchsorted(x, keys[a:b])
                known = x[place] == keys[a:b]
                out[a:b][known] = value[place[known]]
        return out

    def probabilities(self, keys: np.ndarray, n: int, lang: int) -> np.ndarray:
        """Of sorted distinct n-grams of order ``n``."""
        if not n:  # below the shortest n-grams: all characters alike
            return np.full(len(keys), 1.0 / (1 << _BITS))
        shorter, at = np.unique(keys & ((1 << (_BITS * (n - 1))) - 1), return_inverse=True)
        return self.probabilities(shorter, n - 1, lang)[at] * self.find(1, n, lang, keys >> _BITS, 1.0) + self.find(0, n, lang, keys, 0.0)


@lru_cache(maxsize=1)
def _load(path: str, files: tuple[tuple, ...], held_entries: int) -> Model:
    return Model(path, files, held_entries)


def log_probabilities(texts: list[str], lang: np.ndarray, model: Model, rules: Rules) -> tuple[np.ndarray, np.ndarray]:
    """Sum of log10 probabilities and number of characters of each text."""
    key, off = packed(texts, rules.order)
    size = np.diff(off)
    own = np.repeat(lang, size)
    log_p = np.zeros(len(key))
    for number in np.unique(own):
        mine = np.flatnonzero(own == number)
        distinct, at = np.unique(key[mine], return_inverse=True)
        p = model.probabilities(distinct, rules.order, int(number.astype(np.int64)))
        log_p[mine] = np.log10(np.minimum(p, 1.0))[at]
    total = np.concatenate(([0.0], np.cumsum(log_p)))
    return total[off[1:]] - total[off[:-1]], size


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags are set in each row."""
    total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return total[off[1:]] - total[off[:-1]]


def base_counts(part: pa.RecordBatch, rules: Rules) -> dict[str, np.ndarray]:
    """The counts of the base rules for each row."""
    buf, off = text_buffer(part.column("text"))
    starts, ends, row = words_in(buf, off)
    n_words = np.bincount(row, minlength=part.num_rows)
    solid = np.zeros(len(buf) + 1, np.int8)
    solid[starts] += 1
    solid[ends] -= 1
    in_word = np.cumsum(solid[:-1]).astype(bool)
    w, n = rules.repeat_window, len(starts)
    covered = np.zeros(n + 1, np.int64)
    if n >= w:
        h = span_hash(prefix_hash(buf), starts, ends)
        key = np.zeros(n - w + 1, np.uint64)
        for j in range(w):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[j:n - w + 1 + j]
        same_row = row[:n - w + 1] == row[w - 1:]
        at = np.flatnonzero(same_row)
        key = mix64(mix64(key[at]) + row[at].astype(np.uint64))
        order = np.argsort(key, kind="stable")
        run = run_starts(key[order])
        size = np.diff(np.append(run, len(order)))
        twice = at[order[np.repeat(size, size) > 1]]
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + w, -1)
    repeated = np.cumsum(covered)[:n] > 0
    dup = []
    for t in part.column("text").to_pylist():
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        dup.append(len(lines) - len(set(lines)))
    return {"n_words": n_words, "word_chars": per_row(in_word & ((buf & 0xC0) != 0x80), off), "n_symbols": per_row(_SYMBOL[buf], off),
            "n_dup_lines": np.array(dup, np.int64), "n_repeat_words": np.bincount(row[repeated], minlength=part.num_rows)}


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_base(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, lang, text, base counts, base_failed) of every document."""
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", rules.slice_bytes):
                base = base_counts(part, rules)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "lang", "text")] + [pa.array(base[k].astype(np.int64)) for k in _BASE],
                                                 ["doc_id", "lang", "text", *_BASE])
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return docs.mapInArrow(run, "doc_id bigint, lang string, text string, " + ", ".join(f"{k} bigint" for k in _BASE)).withColumn("base_failed", failed)


def score(docs: DataFrame, model_path: str, files: tuple[tuple, ...], rules: Rules) -> DataFrame:
    """The documents of with_base() without their text, and log10 of the perplexity per character."""
    names = ["doc_id", "lang", *_BASE, "base_failed"]

    def run(batches):
        model = _load(model_path, files, rules.held_entries)
        for batch in batches:
            for part in slices(batch, "text", rules.slice_bytes):
                lp, size = log_probabilities(part.column("text").to_pylist(), _lang_number(part.column("lang").to_pylist()), model, rules)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + [pa.array(-lp / np.maximum(size, 1))], [*names, "log_ppl"])
    return docs.mapInArrow(run, "doc_id bigint, lang string, " + ", ".join(f"{k} bigint" for k in _BASE) + ", base_failed boolean, log_ppl double")


def bands(scored: DataFrame, rules: Rules) -> DataFrame:
    """(lang, low, high): from counts of values rounded to 1/10000, so no group of documents meets in a task."""
    def median(counts: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("lang").orderBy("v")
        return (counts.withColumn("upto", F.sum("n").over(w)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
                .filter(2 * F.col("upto") >= F.col("all")).groupBy("lang").agg(F.min("v").alias(name)))
    v = scored.filter(~F.col("base_failed")).select(F.coalesce("lang", F.lit("")).alias("lang"), F.round(F.col("log_ppl") * 10000).cast("bigint").alias("v"))
    counted = v.groupBy("lang", "v").agg(F.count(F.lit(1)).alias("n"))
    middle = median(counted, "mid")
    away = counted.join(middle, "lang").select("lang", F.abs(F.col("v") - F.col("mid")).alias("v"), "n").groupBy("lang", "v").agg(F.sum("n").alias("n"))
    mad = median(away, "mad")
    width = F.greatest(F.col("mad") / 10000.0, F.lit(rules.least))
    return middle.join(mad, "lang").select("lang", (F.col("mid") / 10000.0 - rules.below * width).alias("low"),
                                           (F.col("mid") / 10000.0 + rules.above * width).alias("high"))


def quality(docs: DataFrame, rules: Rules = CORPUS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, base counts, perplexity, low, high, base_failed, kept) for every document."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = write_out(with_base(rows, rules), "base")
    ngrams = write_out(count_ngrams(rows, rules), "ngrams")
    model = write_out(build_model(ngrams, rules), "kneser-ney")
    # a model without entries may have no file
    path = (model.inputFiles() or [""])[0].rsplit("/", 1)[0]
    scored = write_out(score(rows, path, model_files(model), rules), "scored")
    for done in (rows, ngrams, model):  # the scores are all that is read from here on
        discard(done)
    band = bands(scored, rules).withColumnRenamed("lang", "_lang")
    inside = F.col("log_ppl").between(F.col("low"), F.col("high"))
    return (scored.join(band, F.coalesce("lang", F.lit("")) == F.col("_lang"), "left").drop("_lang")
            .withColumn("perplexity", F.pow(F.lit(10.0), "log_ppl"))
            .withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))))
