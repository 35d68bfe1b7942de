from pyspark.sql import functions as F

from quantloom.llm import mixing


def test_a_step_of_raking_is_one_aggregation_and_one_join(spark, monkeypatch):
    rows = [(s, l, t, float(1 + i)) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens double")
    plans, write = [], mixing.write_out

    def noted(df, name="stage"):
        if name == "raked":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(mixing, "write_out", noted)
    out = mixing.rake(mixing.write_out(cells), mixing.tempered_targets(cells, mixing.Raking()))
    assert out.columns == ["source", "lang", "topic", "tokens", "weight", "off"]
    assert plans and max(p.count("Aggregate ") for p in plans) == 1 and max(p.count("Join ") for p in plans) == 1
    total = sum(r[3] for r in rows)
    want = {(r.dim, r.value): r.share for r in mixing.tempered_targets(cells, mixing.Raking()).collect()}
    for d in mixing.DIMENSIONS:
        for r in out.groupBy(F.col(d).alias("v")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("n")).collect():
            assert abs(r.n / total - want[d, r.v]) < 1e-6
