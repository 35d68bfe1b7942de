"""Factor registry: a JSON document of factors as a table of (fid, formula, features, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SCHEMA = "factors map<string, struct<" + (
    "formula: string, gate_status: string, registered_at: string, features: array<string>, "
    "metrics: struct<formula: string, features: array<string>, FM_tstat: double, FM_n_periods: bigint, "
    "Rank_IC: double, ICIR: double, LS_spread: double>, "
    "FM_tstat: double, Rank_IC: double, ICIR: double>>")


def read_registry(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """Registered factors; metrics may be nested or flat; rows without formula or features drop."""
    raw = spark.read.schema(SCHEMA).json(path, multiLine=True)
    e = raw.select(F.explode("factors").alias("fid", "e"))
    pick = lambda n: F.coalesce(F.col(f"e.metrics.{n}"), F.col(f"e.{n}"))
    df = e.select("fid", pick("formula").alias("formula"), F.col("e.gate_status").alias("gate_status"),
                  pick("features").alias("features"), pick("FM_tstat").alias("fm_t"),
                  pick("Rank_IC").alias("rank_ic"), pick("ICIR").alias("icir"),
                  F.col("e.metrics.FM_n_periods").alias("n_periods"),
                  F.col("e.metrics.LS_spread").alias("ls_spread"), F.col("e.registered_at").alias("registered_at"))
    df = df.filter((F.length("formula") > 0) & (F.size("features") > 0))
    return df.filter(F.col("fid").isin(ids)) if ids else df


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Latest entry per id, later registrations win."""
    both = old.unionByName(new, allowMissingColumns=True)
    w = Window.partitionBy("fid").orderBy(F.desc("registered_at"))
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def write_registry(df: DataFrame, path: str, version: str = "1") -> None:
    """Write the table as one document {factors: {id: entry}, meta: {version}}."""
    entry = F.struct(*[c for c in df.columns if c != "fid"])
    doc = df.agg(F.map_from_entries(F.collect_list(F.struct("fid", entry))).alias("factors"))
    doc.withColumn("meta", F.struct(F.lit(version).alias("version"))).coalesce(1).write.mode("overwrite").json(path)
