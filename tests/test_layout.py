import time

from pyspark.sql import functions as F

from quantloom.operators.layout import write_out


def test_shuffles_behind_a_written_table_are_removed(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    df = spark.range(10_000).repartition(4, "id").groupBy((F.col("id") % 100).alias("k")).count()  # held, so the JVM can't collect it
    assert write_out(df).count() == 100
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    left = [x for x in shuffled() - before if x.endswith(".data")]
    assert len(left) <= 4, left  # those of count()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    assert df.count() == 100  # its own plan still runs
