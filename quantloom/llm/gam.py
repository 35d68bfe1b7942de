"""Quality classifier: a generalised additive model with pairwise interactions, read from lookup tables.

Every feature of a text is cut into bins. Boosting goes round the features in turn: each step fits a shallow tree of
one feature to the current gradients and adds a small share of it to that feature's table. With the single features
settled, the pairs whose joint cut lowers the loss most are boosted the same way, each into a table over two features'
bins. A text's score is then the sum of one entry per table, put through the logistic function, so every verdict can be
read off feature by feature (``Model.terms``).

The model is fitted on the driver from a bounded sample: at most ``Fit.per_class`` labelled documents of each class,
those with the smallest hash of their id, weighted so that the classes keep their shares. Scoring reads every text once.

Results for odd input: a null text is an empty one, and empty texts have a score like any other; a null id is scored,
counts as held out and is never learned from. A document labelled twice has its larger label; null labels are left out;
of several rows with a labelled id the one with the smallest features is learned from, and each row is scored. Without
labels of both classes every score is the smoothed share of the good ones (0.5 without any). An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import text_rows

#: What a text is judged by; shares are of its bytes, words or lines.
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "beyond_ascii", "other_control",
            "distinct_words", "top_word", "repeated_triples", "repeated_lines", "byte_entropy", "compressed", "odd_endings",
            "capitalised", "short_words", "long_words", "words_per_line")

_UPPER = np.arange(ord("A"), ord("Z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@[\\]^_`{|}~", np.uint8)
_MARKS = np.frombuffer(b"!?", np.uint8)
_STOPS = np.frombuffer(b".,;:'\"()-", np.uint8)
_SPACES = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_ENDS_WELL = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,;:?!'\")") | frozenset(range(128, 256))


def features_of(text: bytes) -> tuple[float, ...]:
    """The numbers of FEATURES for one text."""
    n = len(text)
    if not n:
        return (0.0,) * len(FEATURES)
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = by_byte / n
    seen = share[share > 0]
    words = text.split()
    k = max(len(words), 1)
    counts = Counter(words)
    triples = len(words) - 2
    lines = [x for x in (y.strip() for y in text.split(b"\n")) if x]
    m = max(len(lines), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return (
        float(np.log1p(n)), float(np.log1p(len(words))), float(lengths.sum()) / k,
        float(share[_UPPER].sum()), float(share[_DIGITS].sum()), float(share[_SYMBOLS].sum()), float(share[_MARKS].sum()),
        float(share[_STOPS].sum()), float(share[128:].sum()), float(share[:32].sum() - share[_SPACES[1:]].sum()),
        len(counts) / k, max(counts.values(), default=0) / k,
        1 - len(set(zip(words, words[1:], words[2:]))) / triples if triples > 0 else 0.0,
        1 - len(set(lines)) / m, float(-(seen * np.log2(seen)).sum()), len(zlib.compress(text, 1)) / n,
        sum(w[-1] not in _ENDS_WELL for w in words) / k, sum(65 <= w[0] <= 90 for w in words) / k,
        float((lengths <= 1).sum()) / k, float((lengths > 20).sum()) / k, float(np.log1p(len(words) / m)),
    )


@dataclass(frozen=True)
class Fit:
    """How a model is fitted; ``per_class`` bounds the labelled documents of each class that are learned from."""
    per_class: int = 20_000
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.1
    leaves: int = 4
    ridge: float = 2.0
    #: least sum of second derivatives in a leaf
    least: float = 1.0


@dataclass
class Model:
    start: float
    #: inner bounds of the bins of each feature, and one table entry per bin
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    #: coarser bounds for pairs, and (feature, feature, table)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def terms(self, x: np.ndarray) -> np.ndarray:
        """What each table adds to the log odds of each row: one column per feature, then one per pair."""
        out = [t[np.searchsorted(c, x[:, i], side="right")] for i, (c, t) in enumerate(zip(self.cuts, self.tables))]
        coarse = {i: np.searchsorted(self.pair_cuts[i], x[:, i], side="right") for p in self.pairs for i in p[:2]}
        out += [t[coarse[a], coarse[b]] for a, b, t in self.pairs]
        return np.stack(out, axis=1) if out else np.zeros((len(x), 0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        return 1 / (1 + np.exp(-(self.start + self.terms(x).sum(axis=1))))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Bounds between about equally many rows; few distinct values get a bin each."""
    values = np.unique(x)
    if len(values) > bins:
        values = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
        return values
    return (values[1:] + values[:-1]) / 2


def _best_cut(g: np.ndarray, h: np.ndarray, fit: Fit) -> tuple[float, int, int]:
    """(gain, axis, place) of the cut of a grid of gradients that lowers the loss most."""
    whole = g.sum() ** 2 / (h.sum() + fit.ridge)
    best = (0.0, 0, 0)
    for axis in range(2):
        if g.shape[axis] < 2:
            continue
        gl, hl = g.sum(axis=1 - axis).cumsum()[:-1], h.sum(axis=1 - axis).cumsum()[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = gl ** 2 / (hl + fit.ridge) + gr ** 2 / (hr + fit.ridge) - whole
        gain[(hl < fit.least) | (hr < fit.least)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), axis, at + 1)
    return best


def shallow_tree(g: np.ndarray, h: np.ndarray, fit: Fit) -> np.ndarray:
    """The values of a tree of at most ``leaves`` leaves over a grid of gradients, grown where the gain is largest."""
    leaves = [(slice(0, g.shape[0]), slice(0, g.shape[1]))]
    cuts = [_best_cut(g, h, fit)]
    while len(leaves) < fit.leaves:
        i = max(range(len(leaves)), key=lambda j: cuts[j][0])
        gain, axis, at = cuts[i]
        if gain <= 0:
            break
        area = leaves.pop(i)
        cuts.pop(i)
        for part in (slice(area[axis].start, area[axis].start + at), slice(area[axis].start + at, area[axis].stop)):
            leaf = (part, area[1]) if axis == 0 else (area[0], part)
            leaves.append(leaf)
            cuts.append(_best_cut(g[leaf], h[leaf], fit))
    out = np.zeros(g.shape)
    for leaf in leaves:
        out[leaf] = -g[leaf].sum() / (h[leaf].sum() + fit.ridge)
    return out


def fit_model(x: np.ndarray, y: np.ndarray, weight: np.ndarray, fit: Fit = Fit()) -> Model:
    """Boost tables for ``x`` (rows, features) towards the 0/1 labels ``y``."""
    good, every = float((weight * y).sum()), float(weight.sum())
    start = float(np.log((good + 0.5) / (every - good + 0.5)))
    if not 0 < good < every:
        return Model(start)
    columns = range(x.shape[1])
    cuts = [_cuts(x[:, i], fit.bins) for i in columns]
    binned = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    odds = np.full(len(y), start)

    def gradients():
        p = 1 / (1 + np.exp(-odds))
        return weight * (p - y), weight * p * (1 - p)

    def grid(cells, shape, g, h):
        size = shape[0] * shape[1]
        return np.bincount(cells, g, size).reshape(shape), np.bincount(cells, h, size).reshape(shape)

    for _ in range(fit.rounds):
        for i in columns:
            step = fit.rate * shallow_tree(*grid(binned[i], (len(tables[i]), 1), *gradients()), fit)[:, 0]
            tables[i] += step
            odds += step[binned[i]]

    pair_cuts = [_cuts(x[:, i], fit.pair_bins) for i in columns]
    coarse = [np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(pair_cuts)]
    size = [len(c) + 1 for c in pair_cuts]
    g, h = gradients()
    gains = []
    for a in columns:
        for b in range(a + 1, x.shape[1]):
            gg, hh = grid(coarse[a] * size[b] + coarse[b], (size[a], size[b]), g, h)
            leaf = shallow_tree(gg, hh, fit)
            gains.append((float(-(leaf * gg).sum() - (leaf ** 2 * hh).sum() / 2), a, b))
    chosen = [(a, b) for gain, a, b in sorted(gains, key=lambda t: (-t[0], t[1:]))[:fit.pairs] if gain > 0]
    cells = [coarse[a] * size[b] + coarse[b] for a, b in chosen]
    pair_tables = [np.zeros((size[a], size[b])) for a, b in chosen]
    for _ in range(fit.pair_rounds):
        for cell, table in zip(cells, pair_tables):
            step = fit.rate * shallow_tree(*grid(cell, table.shape, *gradients()), fit)
            table += step
            odds += step.ravel()[cell]
    return Model(start, cuts, tables, pair_cuts, [(a, b, t) for (a, b), t in zip(chosen, pair_tables)])


def _with_features(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = np.array([features_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(found[:, i]) for i in range(len(FEATURES))]], ["doc_id", *FEATURES])
    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES))


def training_sample(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), label: str = "quality", id_col: str = "doc_id",
                    text_col: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, weights) of at most ``per_class`` labelled documents of each class, by id."""
    known = (labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("doc_id"))
             .agg((F.max(label) > 0).cast("int").alias("y")))
    drawn = None
    for y in (0, 1):
        one = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit.per_class)
        drawn = one if drawn is None else drawn.unionByName(one)
    # at most two classes of per_class ids, so the broadcast is bounded; texts don't move
    rows = text_rows(docs, id_col, text_col).join(F.broadcast(drawn), "doc_id", "left_semi")
    found = _with_features(rows).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("x"))
    got = sorted(found.join(F.broadcast(drawn), "doc_id").select("doc_id", "y", "x").collect())
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    y = np.array([r.y for r in got], np.float64)
    taken = Counter(int(v) for v in y)
    weight = np.array([sizes[int(v)] / taken[int(v)] for v in y])
    x = np.array([tuple(r.x) for r in got], np.float64).reshape(-1, len(FEATURES))
    return x, y, weight * (len(y) / weight.sum()) if len(y) else weight


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for every document."""
    def run(batches):
        for batch in batches:
            x = np.array([features_of(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])
    return text_rows(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def held_out(id_col: str, folds: int = 5):
    """Is a document kept from learning? By the checksum of its id as text; null ids always are."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(True))


def quality_scores(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, learned from the labels of those not held out."""
    model = fit_model(*training_sample(docs, labels.filter(~held_out("doc_id")), fit), fit)
    return score_texts(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score",
                                           (F.col("score") >= threshold).cast("int").alias("predicted"))
