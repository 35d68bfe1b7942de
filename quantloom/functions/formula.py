"""Formula factors: a whitelisted Python expression becomes SQL text over feature columns.

Nothing is evaluated in Python: the expression tree is checked against the tables below
and rendered once, so all formulas of a registry run in a single projection.
"""

from __future__ import annotations

import ast
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from quantloom.functions.rolling import at_least, at_most, div, lit


class FormulaError(ValueError):
    """The text is not a formula over the known columns and functions."""


def _clip(x: str, lo: float, hi: float) -> str:
    return at_most(f"({at_least(x, lo)})", hi)


# Clip bounds and thresholds of the protected functions.
_SAFE = {
    "square": lambda x: f"({x} * {x})",
    "abs": lambda x: f"abs({x})",
    "sign": lambda x: f"signum({x})",
    "sigmoid": lambda x: f"(1 / (1 + exp(-{_clip(x, -500, 500)})))",
    "log1p": lambda x: f"log1p({at_least(x, -0.999)})",
    "inv": lambda x: f"(CASE WHEN abs({x}) > 1e-8D THEN {div('1D', x)} WHEN {x} IS NOT NULL THEN 0D END)",
    "cube": lambda x: f"pow({_clip(x, -10, 10)}, 3D)",
    "exp": lambda x: f"exp({_clip(x, -20, 20)})",
    "sqrt": lambda x: f"sqrt({at_least(x, 0)})",
    "tanh": lambda x: f"tanh({_clip(x, -10, 10)})",
    "sin": lambda x: f"sin({x})",
    "cos": lambda x: f"cos({x})",
    "neg": lambda x: f"(-{x})",
    "log": lambda x: f"ln(abs({x}) + 1e-10D)",
}
_SIGNED = _SAFE | {
    "log1p": lambda x: f"(signum({x}) * log1p(abs({x})))",
    "sqrt": lambda x: f"sqrt(abs({x}))",
}
_TWO = {
    "add": lambda a, b: f"({a} + {b})", "sub": lambda a, b: f"({a} - {b})",
    "mul": lambda a, b: f"({a} * {b})",
    "div": lambda a, b: _protected(a, b), "protected_div": lambda a, b: _protected(a, b),
    "min": lambda a, b: f"(CASE WHEN {b} < {a} THEN {b} ELSE {a} END)",
    "max": lambda a, b: f"(CASE WHEN {b} > {a} THEN {b} ELSE {a} END)",
}
_BINARY = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*"}


def _protected(a: str, b: str) -> str:
    return (f"(CASE WHEN abs({b}) >= 1e-8D THEN {div(a, b)}"
            f" WHEN {b} IS NOT NULL THEN 0D END)")


def _render(node: ast.AST, names: set[str], one: dict) -> str:
    if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
        return lit(node.value)
    if isinstance(node, ast.Name):
        if node.id not in names:
            raise FormulaError(f"unknown feature {node.id}")
        return f"`{node.id}`"
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        inner = _render(node.operand, names, one)
        return f"(-{inner})" if isinstance(node.op, ast.USub) else inner
    if isinstance(node, ast.BinOp):
        a, b = _render(node.left, names, one), _render(node.right, names, one)
        if type(node.op) in _BINARY:
            return f"({a} {_BINARY[type(node.op)]} {b})"
        if isinstance(node.op, ast.Div):
            return div(a, b)
        if isinstance(node.op, ast.Pow):
            return f"pow({a}, {b})"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and not node.keywords:
        args = [_render(a, names, one) for a in node.args]
        table = one if len(args) == 1 else _TWO if len(args) == 2 else {}
        if node.func.id in table:
            return table[node.func.id](*args)
    raise FormulaError("unsupported expression")


def to_sql(formula: str, columns: Iterable[str], mode: str = "safe") -> str:
    """SQL for one formula; ``mode`` is ``safe`` (clipped) or ``signed`` (odd functions)."""
    table = {"safe": _SAFE, "signed": _SIGNED}[mode]
    try:
        tree = ast.parse(formula, mode="eval").body
    except SyntaxError as e:
        raise FormulaError(str(e)) from e
    sql = _render(tree, set(columns), table)
    return f"CASE WHEN abs({sql}) < double('infinity') THEN {sql} END"


def evaluate(df: DataFrame, formulas: dict[str, str], keep: Iterable[str],
             mode: str = "safe") -> DataFrame:
    """Key columns plus one column per formula; a bad formula gives a NULL column."""
    out = []
    for fid, text in formulas.items():
        try:
            out.append(F.expr(to_sql(text, df.columns, mode)).alias(fid))
        except FormulaError:
            out.append(F.lit(None).cast("double").alias(fid))
    return df.select(*keep, *out)


def _canonical(node: ast.AST) -> str:
    if isinstance(node, ast.Constant):
        return "K"
    if isinstance(node, ast.Name):
        return "Feat"
    if isinstance(node, ast.UnaryOp):
        inner = _canonical(node.operand)
        return inner if inner == "K" else f"-{inner}"
    if isinstance(node, ast.BinOp):
        a, b = _canonical(node.left), _canonical(node.right)
        if a == b == "K":
            return "K"
        if isinstance(node.op, ast.Mult):  # a constant factor does not change the structure
            parts = sorted(_factors(node))
            parts = [p for p in parts if p != "K"] or ["K"]
            return parts[0] if len(parts) == 1 else "(" + "*".join(parts) + ")"
        if isinstance(node.op, ast.Add):
            return "(" + "+".join(sorted(_terms(node))) + ")"
        return f"({a}{ {ast.Sub: '-', ast.Div: '/', ast.Pow: '**'}.get(type(node.op), '?')}{b})"
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return f"{node.func.id}({','.join(_canonical(a) for a in node.args)})"
    raise FormulaError("unsupported expression")


def _factors(node: ast.AST) -> list[str]:
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Mult):
        return _factors(node.left) + _factors(node.right)
    return [_canonical(node)]


def _terms(node: ast.AST) -> list[str]:
    if isinstance(node, ast.BinOp) and isinstance(node.op, ast.Add):
        return _terms(node.left) + _terms(node.right)
    return [_canonical(node)]


def structure(formula: str) -> str:
    """Shape of a formula: constants to K, features to Feat, sums and products sorted."""
    try:
        return _canonical(ast.parse(formula, mode="eval").body)
    except (SyntaxError, FormulaError):
        return "".join(formula.split())


def with_signature(registry: DataFrame, formula: str = "formula") -> DataFrame:
    @F.pandas_udf(T.StringType())
    def sign(s: pd.Series) -> pd.Series:
        return s.map(structure, na_action="ignore")

    return registry.withColumn("signature", sign(F.col(formula)))


def decode_placeholders(registry: DataFrame, features: DataFrame, formula: str = "formula") -> DataFrame:
    """Replace X<n> by the name of feature n; adds ``decoded`` and ``used`` (distinct names).

    ``features`` (idx, feature) is the feature pool, a few hundred rows at most.
    """
    names = (features.withColumn("_one", F.lit(1)).groupBy("_one")
             .agg(F.map_from_entries(F.collect_list(
                 F.struct(F.concat(F.lit("X"), F.col("idx").cast("string")), "feature"))).alias("_names")))
    tokens = F.split(F.col(formula), r"(?<=\W)|(?=\W)")
    swapped = F.transform(F.col("_tokens"), lambda t: F.coalesce(F.col("_names")[t], t))
    used = F.array_sort(F.array_distinct(F.array_compact(
        F.transform(F.col("_tokens"), lambda t: F.col("_names")[t]))))
    return (registry.withColumn("_one", F.lit(1)).join(F.broadcast(names), "_one")
            .withColumn("_tokens", tokens)
            .withColumn("decoded", F.array_join(swapped, "")).withColumn("used", used)
            .drop("_one", "_tokens", "_names"))


def effective_features(formula: Column, features: Column) -> Column:
    """Number of listed features that occur in the formula text."""
    return F.size(F.filter(features, lambda f: F.contains(formula, f)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def best_per_formula(runs: DataFrame, k: int, score: str = "fitness") -> DataFrame:
    """Best score per formula text, then the k best formulas."""
    best = runs.groupBy("formula").agg(F.max(F.struct(score, "fid")).alias("_b"))
    return (best.select("formula", F.col("_b")[score].alias(score), F.col("_b")["fid"].alias("fid"))
            .orderBy(F.desc(score), "formula").limit(k))
