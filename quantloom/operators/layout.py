"""Physical layout: written tables, group-size checks and time blocks.

Series windows run on ``(symbol, blk)``. A symbol with few rows is one block; a
symbol with more than ``block_rows`` rows is cut at calendar chunks into several
blocks, and the rows just before (and after) a block are copied into it as a halo,
so that no single task ever sorts an unbounded series.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quantloom.settings import DEFAULTS, Settings

SERIES = ("symbol", "blk")
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a private one only in local mode."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    path = tempfile.mkdtemp(prefix="quantloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def write_out(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage: write ``df`` as parquet to the shared folder and read it back.

    Unlike a block-manager cache the copy survives the loss of executors, and scans
    of it still prune columns and push filters. Files of the shuffles behind it go when the
    write ends, not when the driver's JVM happens to collect the plan.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def has_heavy_group(df: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> bool:
    """Does any group exceed the rows one task should sort? One map-side-combined count."""
    sizes = df.groupBy(*keys).count()
    return not sizes.filter(F.col("count") > settings.heavy_group_rows).limit(1).isEmpty()


def time_blocks(panel: DataFrame, settings: Settings = DEFAULTS,
                symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Add ``blk`` and ``halo``; halo rows are copies that only feed neighbouring frames.

    Only symbols above ``block_rows`` get a chunk map, so the map is empty for ordinary
    daily bars and never larger than (big symbols x calendar chunks x blocks touched).
    """
    s = settings
    chunk = F.date_trunc(s.chunk_unit, F.col(date)).cast("date")
    big = (panel.groupBy(symbol).count()
           .filter(F.col("count") > s.block_rows).select(symbol))
    counts = (panel.join(big, symbol, "left_semi")
              .groupBy(symbol, chunk.alias("_chunk")).agg(F.count(F.lit(1)).alias("_n")))
    # one row per (symbol, chunk): bounded by the calendar, so a per-symbol window is safe
    wc = Window.partitionBy(symbol).orderBy("_chunk")
    spans = (counts.withColumn("_end", F.sum("_n").over(wc))
             .withColumn("_start", F.col("_end") - F.col("_n"))
             .withColumn("_own", F.floor(F.col("_start") / F.lit(s.block_rows)).cast("int")))
    blocks = (spans.groupBy(symbol, F.col("_own").alias("_blk"))
              .agg(F.min("_start").alias("_b0"), F.max("_end").alias("_b1")))
    touches = ((F.col("_blk") == F.col("_own"))
               | ((F.col("_blk") > F.col("_own")) & (F.col("_end") > F.col("_b0") - s.halo_back))
               | ((F.col("_blk") < F.col("_own")) & (F.col("_start") < F.col("_b1") + s.halo_forward)))
    chunk_map = (spans.join(blocks, symbol).filter(touches)
                 .select(symbol, "_chunk", F.col("_blk").alias("blk"),
                         (F.col("_blk") != F.col("_own")).alias("halo")))
    # written, so that Spark sees how small it is before it shuffles the panel to it
    chunk_map = write_out(chunk_map, "chunks")
    return (panel.withColumn("_chunk", chunk)
            .join(chunk_map, [symbol, "_chunk"], "left")
            .drop("_chunk")
            .withColumn("blk", F.coalesce("blk", F.lit(0)))
            .withColumn("halo", F.coalesce("halo", F.lit(False))))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("halo")).drop("halo", "blk")
