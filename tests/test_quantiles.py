"""Exact quantiles against Spark's own, which hold all distinct values."""

import random

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import profile, quantiles

POINTS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def both(df, keys, points=POINTS):
    want = df.groupBy(*keys).agg(F.percentile("x", F.array(*map(F.lit, points)), F.col("w")).alias("q")).where("q is not null").collect()
    got = quantiles.exact(df, keys, points).collect()
    return {tuple(r[k] for k in keys): r["quantiles"] for r in got}, {tuple(r[k] for k in keys): r["q"] for r in want}


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_random_groups(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rnd = random.Random(11)
    draw = (lambda: rnd.gauss(0, 1), lambda: float(rnd.randrange(3)), lambda: 10.0 ** rnd.randrange(-12, 12), lambda: rnd.choice([-1.7e308, 1.7e308, 0.0, 5e-324]), lambda: 7.0)
    rows = [(g, i % 2, draw[i % 5](), rnd.choice([1, 1, 2, 30])) for g in ("a", None, "b") for i in range(200)]
    got, want = both(spark.createDataFrame(rows, "g string, h int, x double, w long").repartition(3), ["g", "h"])
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_many_rows_of_few_and_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 50)
    i = F.col("id")
    df = spark.range(20_000).select(F.when(i % 3 == 0, "hot").otherwise("wide").alias("g"), F.when(i % 3 == 0, (i % 2) * 1.5).otherwise((i * 7919 % 20_000) / 3).alias("x"), F.lit(1).cast("long").alias("w"))
    got, want = both(df, ["g"])
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want) and len(got) == 2


def test_nothing_and_one_row(spark):
    none = spark.createDataFrame([], "g string, x double, w long")
    assert quantiles.exact(none, ["g"], POINTS).collect() == []
    assert both(none.union(spark.createDataFrame([("a", 3.0, 1)], none.schema)), ["g"]) == ({("a",): [3.0] * 7}, {("a",): [3.0] * 7})
    assert profile.numeric(none, ["g"], F.col("x")).collect() == [] and profile.numeric_stats(none, ["g"], F.col("x")).collect() == []
