import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomspark.functions import ordered
from loomspark.functions.staging import staged


def brute(rows, keyed):
    out = []
    for _, group in itertools.groupby(sorted(rows, key=lambda r: ((r[0] is not None, r[0] or "") if keyed else 0, r[1])), key=lambda r: r[0] if keyed else 0):
        total, spent = 0, 0.0
        for k, n, v, x in group:
            total, spent = total + (v or 0), spent + (x or 0.0)
            out.append((k, n, total, spent))
    return sorted(out, key=str)


@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("hot", [0, 900])
def test_running_sums(spark, keyed, hot):
    draw = random.Random(hot)
    rows = [("hot" if n < hot else draw.choice(["a", "b", None, "c"]), n, draw.choice([None, 1, -3, 7]), draw.choice([None, 0.5, 2.0])) for n in range(1000)]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, n long, v long, x double").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered.running(df, ["k"] if keyed else [], [F.col("n").asc()], {"total": F.col("v"), "spent": F.col("x")})
        less = ordered.running(df, ["k"] if keyed else [], [F.col("n").asc()], {"total": F.col("v"), "spent": F.col("x")}, before=True)
        assert "Window" not in less._jdf.queryExecution().executedPlan().toString()
        earlier = sorted(((r.k, r.n, r.total + (r.v or 0), r.spent + (r.x or 0.0)) for r in less.collect()), key=str)
        got = sorted(((r.k, r.n, r.total, r.spent) for r in out.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == earlier == brute(rows, keyed)
    assert out.columns == ["k", "n", "v", "x", "total", "spent"]


def test_a_key_with_most_rows_is_split(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(ordered, "staged", lambda df: tables.append(staged(df)) or tables[-1])
    df = spark.range(20000).select(F.when(F.col("id") % 10 < 8, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ordered.running(df, ["k"], [F.col("id").asc()], {"n": F.lit(1)})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert out.groupBy("k").agg(F.max("n").alias("n"), F.count("*").alias("all")).filter("n <> all").count() == 0
        sizes = [r["count"] for r in tables[0].groupBy("_range").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert "SinglePartition" not in plan and len(sizes) > 1 and max(sizes) < 2 * 20000 / len(sizes)


def test_empty(spark):
    assert ordered.running(spark.createDataFrame([], "k string, n long"), ["k"], [F.col("n").asc()], {"t": F.lit(1)}).collect() == []
