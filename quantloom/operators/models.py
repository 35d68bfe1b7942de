"""Model-side operators: sequences, tensor pivot, tree baseline, target shaping, sweeps."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window, functions as F

from quantloom.functions.exprs import clip, normal_quantile
from quantloom.operators import daily, xsection as xs
from quantloom.operators.layout import SERIES, has_heavy_group, write_out
from quantloom.settings import DEFAULTS, Settings


def sequences(blocked: DataFrame, features: Sequence[str], steps: int = 20,
              keys: Sequence[str] = SERIES) -> DataFrame:
    """Array of the last ``steps`` feature rows, left-padded with the oldest one.

    ``blocked`` carries halo rows, so a block's first rows still see their history.
    """
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(-(steps - 1), 0)
    seq = F.collect_list(F.struct(*features)).over(w)
    d = blocked.withColumn("_s", seq)
    pad = F.array_repeat(F.col("_s")[0], F.lit(steps) - F.size("_s"))
    return d.withColumn("sequence", F.concat(pad, F.col("_s"))).drop("_s")


def tensor(bars: DataFrame, symbols: Sequence[str]) -> DataFrame:
    """Wide [date x (channel, symbol)] frame for a fixed, listed set of symbols."""
    d = bars.withColumn("vwap", F.try_divide("amount", F.greatest("volume", F.lit(1.0))))
    return (d.groupBy("date").pivot("symbol", list(symbols))
            .agg(*[F.first(c).alias(c) for c in ("open", "high", "low", "close", "volume", "vwap")]))


def from_wide(wide: DataFrame, panel_keys: DataFrame, value: str = "x") -> DataFrame:
    """Wide [date x symbol] factor back to long, aligned to the panel keys (absent = NULL)."""
    long = wide.unpivot(["date"], [c for c in wide.columns if c != "date"], "symbol", value)
    return panel_keys.select("date", "symbol").join(long, ["date", "symbol"], "left")


def gbt_baseline(df: DataFrame, features: Sequence[str], label: str = "forward_ret", trees: int = 50,
                 depth: int = 5, rate: float = 0.05, seed: int = 42):
    """Boosted trees on train rows with early stopping on validation rows.

    Returns (predictions on test rows, importances). ``df`` carries ``split`` and no NULLs.
    """
    spark = df.sparkSession
    va = VectorAssembler(inputCols=list(features), outputCol="_v")
    data = va.transform(df.filter(F.col(label).isNotNull())).withColumn("_val", F.col("split") == "val")
    model = GBTRegressor(featuresCol="_v", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate,
                         validationIndicatorCol="_val", validationTol=0.001, seed=seed).fit(
        data.filter(F.col("split").isin("train", "val")))
    pred = (model.transform(data.filter(F.col("split") == "test"))
            .withColumnRenamed("prediction", "x").drop("_v", "_val"))
    imp = [(f, float(w)) for f, w in zip(features, model.featureImportances.toArray())]
    return pred, spark.createDataFrame(imp, "feature string, gain_importance double").orderBy(
        F.desc("gain_importance"), "feature")


def rank_gaussian(df: DataFrame, x: str, keys: Sequence[str], out: str, bound: float = 3.0, heavy=None,
                  settings: Settings = DEFAULTS) -> DataFrame:
    """Normal quantile of rank / (n + 1), clipped to +-3."""
    cols = df.columns
    r = xs.average_rank(df, keys, x, "_r", heavy, settings)
    q = normal_quantile(F.col("_r") / (F.col("_r_n") + 1))
    return r.select(*cols, clip(q, -bound, bound).alias(out))


# Operator set of the search, as templates over one or two features.
ONE = ("{a}", "square({a})", "abs({a})", "log1p({a})", "sign({a})", "inv({a})")
TWO = ("{a} + {b}", "{a} - {b}", "{a} * {b}", "{a} / {b}", "square({a} * {b})", "{a} * abs({b})")


def sweep_candidates(features: Sequence[str], per_trial: int = 4, n_trials: int = 1, seed: int = 42,
                     max_complexity: int = 12) -> list[tuple[str, str, int]]:
    """(fid, formula, complexity) from seeded random subsets and the templates above."""
    import random
    rng = random.Random(seed)
    seen: dict[str, int] = {}
    for _ in range(n_trials):
        subset = sorted(rng.sample(list(features), min(per_trial, len(features))))
        texts = [t.format(a=f) for f in subset for t in ONE]
        texts += [t.format(a=a, b=b) for a, b in combinations(subset, 2) for t in TWO]
        for t in texts:
            size = sum(t.count(c) for c in "+-*/(") + sum(t.count(f) for f in subset)
            if size <= max_complexity:
                seen.setdefault(t, size)
    return [(f"CAND_{i:03d}", t, c) for i, (t, c) in enumerate(seen.items())]


def score_candidates(panel: DataFrame, candidates: list[tuple[str, str, int]], top: int = 10, heavy=None,
                     settings: Settings = DEFAULTS) -> DataFrame:
    """Evaluate all candidates in one projection and rank them by |ICIR| in one job."""
    from quantloom.functions import formula
    names, texts = [f for f, _, _ in candidates], {f: t for f, t, _ in candidates}
    if has_heavy_group(panel, ["date"], settings) if heavy is None else heavy:
        wide = formula.evaluate(panel, texts, ["date", "symbol", "ret"])
        ic = xs.rank_ic(write_out(xs.melt(wide, names, ["date", "symbol", "ret"]), "sweep"), heavy=heavy, settings=settings)
    else:
        # the factors cross the network; the candidates, many more, are formed behind it
        near = panel.repartition("date").sortWithinPartitions("date")
        ic = daily.ics(daily.sections(formula.evaluate(near, texts, ["date", "symbol", "ret"]), names))
    s = xs.ic_summary(ic)
    meta = panel.sparkSession.createDataFrame(candidates, "fid string, formula string, complexity int")
    return (s.join(F.broadcast(meta), "fid").withColumn("score", F.abs("icir"))
            # equal up to rounding counts as a tie: the simpler formula wins
            .orderBy(F.desc(F.round("score", 9)), "complexity", "fid").limit(top))
