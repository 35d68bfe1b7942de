"""Correlations of every pair of features over the rows where both exist.

A feature's rank depends on which rows it is ranked among, so a pair with NULLs needs ranks of its own. Features
with the same pattern of NULLs share them: each value gets one rank per *null group* of features, all from one
sort, as running counts of the rows where that group exists. A row's ranks then meet in matrix products, one per
pair of null groups, whose sums add up over batches and tasks. No row is dropped and no pair is ranked again.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.functions.exprs import ratio
from quantloom.operators import xsection as xs
from quantloom.operators.layout import write_out
from quantloom.settings import DEFAULTS, Settings

MAX_POOL = 2000  # features; a task holds a few (features x features) matrices
_ROWS = 1024     # rows whose ranks are multiplied at a time


def _checked(features: Sequence[str]) -> list[str]:
    feats = list(features)
    if len(feats) > MAX_POOL:
        raise ValueError(f"{len(feats)} features; pairs are limited to {MAX_POOL}")
    return feats


def null_groups(df: DataFrame, features: Sequence[str]) -> list[int]:
    """For each feature the position of the first feature that is NULL in the same rows. One aggregate pass.

    Two features agree when the hashes of the rows where they are NULL have equal counts and sums.
    """
    feats = _checked(features)
    marks = [F.xxhash64(F.lit(seed), *feats).cast("decimal(20,0)").alias(f"m{seed}") for seed in (1, 2)]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(feats)]))
    sums = (df.select(*marks, F.explode(missing).alias("f")).groupBy("f")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("m1").alias("s1"), F.sum("m2").alias("s2")).collect())  # a row per feature at most
    found = {r.f: (r.n, r.s1, r.s2) for r in sums}
    first: dict = {}
    return [first.setdefault(found.get(i), i) for i in range(len(feats))]


def ranks_among(x: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """For each 0/1 column of ``marks`` the average-tie rank of ``x`` among the rows where it is 1, less the mean rank; 0 elsewhere."""
    if not len(x):
        return np.zeros(marks.shape)
    order = np.argsort(x, kind="stable")
    new = np.r_[True, x[order][1:] != x[order][:-1]]
    run = np.cumsum(new) - 1
    here = np.add.reduceat(marks[order].astype(np.int64), np.flatnonzero(new))
    upto = np.cumsum(here, axis=0)
    out = np.empty(marks.shape)
    out[order] = (upto - (here - 1) / 2 - (upto[-1] + 1) / 2)[run]
    return out * marks


def context_ranks(long: DataFrame, keys: Sequence[str], contexts: Sequence[str], x: str = "x",
                  heavy: bool | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``ranks``, those of :func:`ranks_among` for the 0/1 columns ``contexts``, per group. Rows without ``x`` go.

    A group of at most ``heavy_group_rows`` rows, as a count has shown, is sorted in one task.
    """
    keys = list(keys)
    light, big = xs._parts(long, keys, x, heavy, settings)
    names = [c for c in long.columns if c not in contexts and c != x]
    kinds = dict(long.dtypes)

    def sort(table: pa.Table) -> pa.Table:
        marks = np.stack([table.column(c).to_numpy() for c in contexts], axis=1)
        found = ranks_among(table.column(x).to_numpy(), marks)
        return table.select(names).append_column("ranks", pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), len(contexts)).cast(pa.list_(pa.float64())))
    res = light.groupBy(*keys).applyInArrow(sort, ", ".join(f"{c} {kinds[c]}" for c in names) + ", ranks array<double>")
    if big is None:
        return res

    def ranks(upto, here, total):
        centred = [F.when(F.col(c) == 1, upto(c) - (here(c) - 1) / 2 - (total(c) + 1) / 2).otherwise(0.0) for c in contexts]
        return F.array(*centred).alias("ranks")

    # heavy groups: equal values collapse before the shuffle, and cells of values carry running counts to the next
    values = big.groupBy(*keys, xs.order_cell(F.col(x)).alias("_cell"), x).agg(*[F.sum(c).alias(f"_h_{c}") for c in contexts])
    hist = values.groupBy(*keys, "_cell").agg(*[F.sum(f"_h_{c}").alias(f"_n_{c}") for c in contexts])
    wh, wk, wv = Window.partitionBy(*keys).orderBy("_cell"), Window.partitionBy(*keys), Window.partitionBy(*keys, "_cell").orderBy(x)
    hist = hist.select(*keys, "_cell", *[(F.sum(f"_n_{c}").over(wh) - F.col(f"_n_{c}")).alias(f"_b_{c}") for c in contexts],
                       *[F.sum(f"_n_{c}").over(wk).alias(f"_t_{c}") for c in contexts])
    cells = values.join(hist, keys + ["_cell"]).select(
        *keys, x, *[(F.col(f"_b_{c}") + F.sum(f"_h_{c}").over(wv)).alias(f"_u_{c}") for c in contexts],
        *[F.col(f"_{k}_{c}") for k in "ht" for c in contexts])
    of = lambda k: lambda c: F.col(f"_{k}_{c}")
    return res.unionByName(big.join(cells, [*keys, x]).select(*names, ranks(of("u"), of("h"), of("t"))))


class _Products:
    """Sums over rows' ranks: cross products of pairs, squares of each feature per null group, rows per pair of groups."""

    def __init__(self, group: list[int]):
        self.of = np.array(group)
        self.members = [np.flatnonzero(self.of == g) for g in range(self.of.max() + 1)]
        self.first, self.second = np.triu_indices(len(group), 1)

    def empty(self) -> list[np.ndarray]:
        f, g = len(self.of), len(self.members)
        return [np.zeros((f, f)), np.zeros((f, g)), np.zeros((g, g))]

    def add(self, sums: list[np.ndarray], ranks: np.ndarray, there: np.ndarray) -> None:
        """``ranks`` is (rows, features, groups), 0 where the feature or the group is missing; ``there`` (rows, features)."""
        for g, a in enumerate(self.members):
            for h, b in enumerate(self.members):
                sums[0][np.ix_(a, b)] += ranks[:, a, h].T @ ranks[:, b, g]
        sums[1] += (ranks * ranks).sum(axis=0)
        some = there[:, [m[0] for m in self.members]].astype(float)
        sums[2] += some.T @ some

    def table(self, sums: list[np.ndarray]) -> dict[str, pa.Array]:
        cross, square, both = sums
        i, j = self.first, self.second
        return {"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "n": pa.array(both[self.of[i], self.of[j]].astype(np.int64)),
                "sxy": pa.array(cross[i, j]), "sxx": pa.array(square[i, self.of[j]]), "syy": pa.array(square[j, self.of[i]])}


_SUMS = "i int, j int, n long, sxy double, sxx double, syy double"


def _group_sums(wide: DataFrame, feats: list[str], by: list[str], products: _Products) -> DataFrame:
    """Sums of every group of ordinary size, ranked and multiplied where it lies."""
    heads = [m[0] for m in products.members]
    kinds = dict(wide.dtypes)

    def run(table: pa.Table) -> pa.Table:
        v = np.stack([table.column(c).to_numpy() for c in feats], axis=1).astype(float)
        there = ~np.isnan(v)
        marks = there[:, heads]
        sums = products.empty()
        ranks = np.zeros((*v.shape, len(heads)))
        for k in range(len(feats)):
            own = there[:, k]
            ranks[own, k] = ranks_among(v[own, k], marks[own])
        for at in range(0, len(v), _ROWS):
            products.add(sums, ranks[at:at + _ROWS], there[at:at + _ROWS])
        done = products.table(sums)
        size = len(done["n"])
        keys = {c: pa.array([table.column(c)[0].as_py()] * size, table.schema.field(c).type) for c in by}
        return pa.table(keys | done)
    return wide.groupBy(*by).applyInArrow(run, "".join(f"{c} {kinds[c]}, " for c in by) + _SUMS)


_WORD = 60        # marks in one integer
_CELLS_PER_E = 128  # ordered cells of values per factor e in magnitude, each ranked in one task
_ALIKE = 1 << 17  # rows of a cell with a single value that one task takes
_HELD_ROWS = 1 << 21  # numbers of a block of rows that meet again


def _row_sums(wide: DataFrame, feats: list[str], by: list[str], marks: list[str], products: _Products) -> DataFrame:
    """Sums from ranks that are made per feature and meet again by row.

    A value crosses the network with its row's number to the other values of its cell, where running counts of the
    cells below give its ranks, and its ranks once more to the other features of its block of rows.
    """
    size, width = len(feats), len(marks)
    kinds = dict(wide.dtypes)
    words = [f"_w{i}" for i in range(-(-width // _WORD))]
    packed = [reduce(lambda a, b: a + b, [F.col(m).cast("long") * F.lit(1 << i) for i, m in enumerate(marks[k * _WORD:(k + 1) * _WORD])]).alias(w)
              for k, w in enumerate(words)]
    rows = wide.select(*by, *packed, F.monotonically_increasing_id().alias("_row"), *feats)
    values = F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).cast("double").alias("x")) for i, c in enumerate(feats)])
    long = rows.select(*by, *words, "_row", F.inline(values)).filter(F.col("x").isNotNull()).withColumn("_cell", xs.order_cell(F.col("x"), _CELLS_PER_E))
    here = [f"_n{i}" for i in range(width)]
    hist = long.groupBy(*by, "f", "_cell").agg(*[F.sum(F.shiftright(words[i // _WORD], i % _WORD).bitwiseAND(F.lit(1))).alias(n) for i, n in enumerate(here)],
                                                F.count(F.lit(1)).alias("_rows"), (F.min("x") == F.max("x")).alias("_one"))
    upto, every = Window.partitionBy(*by, "f").orderBy("_cell"), Window.partitionBy(*by, "f")
    cells = write_out(hist.select(*by, "f", "_cell", F.array(*[F.sum(n).over(upto) - F.col(n) for n in here]).alias("_below"),
                                  F.array(*[F.sum(n).over(every) for n in here]).alias("_total"),
                                  F.array(*here).alias("_here"), "_one", F.when(F.col("_one"), F.floor(F.col("_rows") / F.lit(_ALIKE)) + 1).otherwise(F.lit(1)).alias("_parts")), "cells")
    keys = [*by, "f", "_cell"]

    def rank(table: pa.Table) -> pa.Table:
        bits = np.stack([table.column(w).to_numpy() for w in words], axis=1)
        there = np.stack([(bits[:, i // _WORD] >> (i % _WORD)) & 1 for i in range(width)], axis=1)
        base = np.array(table.column("_below")[0].as_py()) - (np.array(table.column("_total")[0].as_py()) + 1) / 2
        if table.column("_one")[0].as_py():  # equal values: known from the counts, whatever part of the cell this is
            own = there * ((np.array(table.column("_here")[0].as_py()) + 1) / 2 + base)
        else:
            own = ranks_among(table.column("x").to_numpy(), there) + there * ((there.sum(axis=0) + 1) / 2 + base)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(own.ravel()), width).cast(pa.list_(pa.float64()))
        return table.select([*by, "f", "_row"]).append_column("ranks", lists)
    cut = cells.filter("_parts > 1").select(*keys, "_parts")
    parts = long.join(F.broadcast(cut), keys, "left").withColumn("_part", F.pmod("_row", F.coalesce("_parts", F.lit(1)))).drop("_parts")
    near = parts.repartition(*keys, "_part").join(cells.drop("_parts"), keys)
    ranked = near.groupBy(*keys, "_part").applyInArrow(rank, "".join(f"{c} {kinds[c]}, " for c in by) + "f int, _row long, ranks array<double>")
    shift = max(4, min(14, (_HELD_ROWS // (size * width)).bit_length() - 1))
    blocks = ranked.withColumn("_block", F.shiftright("_row", shift))

    def add(sums, table):
        row, feature = table.column("_row").to_numpy(), table.column("f").to_numpy()
        _, at = np.unique(row, return_inverse=True)
        ranks, there = np.zeros((at.max() + 1, size, width)), np.zeros((at.max() + 1, size), bool)
        ranks[at, feature] = table.column("ranks").combine_chunks().flatten().to_numpy().reshape(-1, width)
        there[at, feature] = True
        for start in range(0, len(ranks), _ROWS):
            products.add(sums, ranks[start:start + _ROWS], there[start:start + _ROWS])

    if by:
        def multiply(table: pa.Table) -> pa.Table:
            sums = products.empty()
            add(sums, table)
            done = products.table(sums)
            return pa.table({c: pa.array([table.column(c)[0].as_py()] * len(done["n"]), table.schema.field(c).type) for c in by} | done)
        return blocks.groupBy(*by, "_block").applyInArrow(multiply, "".join(f"{c} {kinds[c]}, " for c in by) + _SUMS)

    def run(batches):
        """Whole blocks at a time: a block may go on in the next batch."""
        sums, rest, any_row = products.empty(), None, False
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            block = table.column("_block").to_numpy()
            last = int(np.searchsorted(block, block[-1])) if len(block) else 0
            if last:
                add(sums, table.slice(0, last))
                any_row = True
            rest = table.slice(last)
        if rest is not None and rest.num_rows:
            add(sums, rest)
            any_row = True
        if any_row:
            yield pa.RecordBatch.from_pydict(products.table(sums))
    return blocks.repartition("_block").sortWithinPartitions("_block").mapInArrow(run, _SUMS)


def pair_spearman(df: DataFrame, features: Sequence[str], by: Sequence[str] = (), keys: Sequence[str] = ("date", "symbol"),
                  heavy: bool | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """(by, f1, f2, n, rho) for f1 before f2: rank correlation over the ``n`` rows of a group where both exist.

    ``keys`` tell rows apart and include ``by``. NULL for fewer than two rows and for a side without differences.
    """
    feats, by, keys = _checked(features), list(by), list(keys)
    heads = null_groups(df, feats)
    groups = sorted(set(heads))
    products = _Products([groups.index(g) for g in heads])
    marks = [f"_g{i}" for i in range(len(groups))]
    wide = df.select(*keys, *feats, *[F.col(feats[g]).isNotNull().cast("tinyint").alias(m) for g, m in zip(groups, marks)])
    if by and not (xs.has_heavy_group(df, by, settings) if heavy is None else heavy):
        part = _group_sums(wide.select(*dict.fromkeys([*by, *feats])), feats, by, products)
    else:
        part = _row_sums(wide, feats, by, marks, products)
    total = part.groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sxy", "sxx", "syy")])
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in feats]), F.col(c) + 1)
    flat = (F.col("sxx") <= 0) | (F.col("syy") <= 0)
    return total.select(*by, name("i").alias("f1"), name("j").alias("f2"), "n",
                        F.when(~flat, F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy"))).alias("rho"))


def pair_pearson(wide: DataFrame, features: Sequence[str]) -> DataFrame:
    """(f1, f2, n, rho) for f1 before f2: Pearson correlation over the rows where both exist; NULL for a flat side.

    Each task multiplies its rows, less the features' means, and hands on one row of sums per pair.
    """
    feats = _checked(features)
    centre = np.array([0.0 if v is None else v for v in wide.agg(*[F.avg(c).alias(c) for c in feats]).head()])
    size = len(feats)
    first, second = np.triu_indices(size, 1)

    def run(batches):
        sums = np.zeros((6, size, size))
        for batch in batches:
            v = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in feats], axis=1) - centre
            there = ~np.isnan(v)
            v, m = np.where(there, v, 0.0), there.astype(float)
            sums += np.stack([m.T @ m, v.T @ m, m.T @ v, (v * v).T @ m, m.T @ (v * v), v.T @ v])
        n, sx, sy, sxx, syy, sxy = (s[first, second] for s in sums)
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(n.astype(np.int64)),
                                          *map(pa.array, (sx, sy, sxx, syy, sxy))], ["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    names = ("n", "sx", "sy", "sxx", "syy", "sxy")
    part = wide.select(*[F.col(c).cast("double").alias(c) for c in feats]).mapInArrow(run, "i int, j int, n long, sx double, sy double, sxx double, syy double, sxy double")
    t = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in names])
    n, sx, sy, sxx, syy, sxy = map(F.col, names)
    vx, vy = sxx - F.try_divide(sx * sx, n), syy - F.try_divide(sy * sy, n)
    name = lambda c: F.element_at(F.array(*[F.lit(f) for f in feats]), F.col(c) + 1)
    flat = (vx <= 1e-12 * sxx) | (vy <= 1e-12 * syy)
    return t.select(name("i").alias("f1"), name("j").alias("f2"), "n", F.when(~flat, ratio(sxy - F.try_divide(sx * sy, n), F.sqrt(vx * vy))).alias("rho"))


def components(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(node, grp): the smallest node that each one reaches over ``edges`` (a, b), by rounds of joins until nothing changes."""
    links = write_out(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = write_out(nodes.select(F.col(node).alias("a"), F.col(node).alias("grp")), "labels")
    while True:
        near = links.join(label.select(F.col("a").alias("b"), "grp"), "b").groupBy("a").agg(F.min("grp").alias("_near"))
        low = label.join(near, "a", "left").select("a", "grp", F.least("grp", F.coalesce("_near", "grp")).alias("_low"))
        # the label's own label: halves the way to the smallest
        own = label.select(F.col("a").alias("_low"), F.col("grp").alias("_own"))
        new = write_out(low.join(own, "_low").select("a", F.least("_low", "_own").alias("grp"), (F.least("_low", "_own") < F.col("grp")).alias("moved")), "labels")
        label = new.select("a", "grp")
        if new.filter("moved").isEmpty():
            return label.withColumnRenamed("a", node)


def complete_linkage(nodes: DataFrame, distances: DataFrame, node: str) -> DataFrame:
    """(a, b, height): the merges of complete-linkage clustering, ``a`` before ``b`` named by their smallest members.

    ``distances`` is (a, b, d) with a row per pair. Every round merges all pairs of clusters that are each other's
    nearest, which complete linkage allows since a merge never brings clusters closer; ties go to the smaller names.
    """
    left = write_out(distances.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"), "distances")
    rounds = []
    while not left.isEmpty():
        pick = F.struct("d", "a", "b")
        sides = left.select(F.col("a").alias("c"), pick.alias("p")).unionByName(left.select(F.col("b").alias("c"), pick.alias("p")))
        best = sides.groupBy("c").agg(F.min("p").alias("p"))
        merges = write_out(best.groupBy("p").count().filter("count = 2").select("p.a", "p.b", F.col("p.d").alias("height")), "merges")
        rounds.append(merges)
        gone = {c: merges.select(F.col("b").alias(c), F.col("a").alias(f"_{c}")) for c in "ab"}
        moved = (left.join(gone["a"], "a", "left").join(gone["b"], "b", "left")
                 .select(F.coalesce("_a", "a").alias("p"), F.coalesce("_b", "b").alias("q"), "d").filter("p <> q"))
        left = write_out(moved.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.max("d").alias("d")), "distances")
    if not rounds:
        return nodes.select(F.col(node).alias("a"), F.col(node).alias("b"), F.lit(0.0).alias("height")).limit(0)
    return reduce(DataFrame.unionByName, rounds)
