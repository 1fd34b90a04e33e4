"""Key search against all sets of fields, counted in Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vitalframe.operators import keys, relations
from vitalframe.operators.profile import fields as profile_fields
from vitalframe.plans import analyze


def brute(rows, fields, least):
    for size in range(1, len(fields) + 1):
        for s in itertools.combinations(fields, size):
            if rows and len({tuple(r[f] for f in s) for r in rows}) >= least * len(rows):
                return list(s)
    return None


def frame(spark, rows, fields):
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], ", ".join("`" + f.replace("`", "``") + "` bigint" for f in fields))


@pytest.mark.parametrize("seed", range(6))
def test_random_tables(spark, seed):
    rng = random.Random(seed)
    fields = ["a", "b.c", "d", "e`e", "f"]
    sizes = [rng.choice((1, 2, 3, 6, 12)) for _ in fields]
    rows = [{f: rng.choice([None, *range(n)]) for f, n in zip(fields, sizes)} for _ in range(rng.choice((1, 20, 60)))]
    least = (1.0, 0.95, 0.8)[seed % 3]
    assert keys.find_key(frame(spark, rows, fields), fields, least) == brute(rows, fields, least)


def mixed_radix(spark, rows=4000):
    return spark.range(rows).selectExpr("id % 7 AS a", "id div 7 % 5 AS b", "id div 35 % 9 AS c", "id div 315 AS d", "id % 2 AS noise", "1 AS constant")


def test_four_fields(spark):
    for least in (1.0, 0.95):
        assert keys.find_key(mixed_radix(spark), ["noise", "constant", "a", "b", "c", "d"], least) == ["a", "b", "c", "d"]


def test_four_fields_in_a_profile(spark):
    tables = {"t": mixed_radix(spark)}
    assert sorted(relations.primary_keys(tables, profile_fields(analyze.counts_of(tables), analyze.row_counts(tables)))["t"]) == ["a", "b", "c", "d"]


def test_climbing_alone_gives_a_key_that_spares_nothing(spark, monkeypatch):
    monkeypatch.setattr(keys, "LOOKED_AT", 0)
    df = mixed_radix(spark)
    assert keys.find_key(df, df.columns) == ["a", "b", "c", "d"]
    # One field more than needed is climbed over first, then taken off.
    spread = spark.range(900).selectExpr("id div 3 AS wide", "id % 30 AS x", "id div 30 AS y")
    assert keys.find_key(spread, spread.columns) in (["x", "y"], ["wide", "x"])
    monkeypatch.setattr(keys, "LOOKED_AT", 100)
    assert keys.find_key(spread, spread.columns) == ["wide", "x"]


def test_rows_that_are_told_apart_late(spark, monkeypatch):
    """Sketches can't see the last rows: they are set aside, and the rest decides."""
    seen = []
    monkeypatch.setattr(keys, "settle", lambda df: seen.append(df.count()) or df)
    df = spark.range(5000).selectExpr("id - id % 2 * cast(id < 20 as int) AS most", "id % 2 AS last", "id div 2 % 3 AS other")
    assert keys.find_key(df, ["other", "most", "last"]) == ["most", "last"] == brute([r.asDict() for r in df.collect()], ["other", "most", "last"], 1.0)
    assert keys.find_key(df, ["most", "last"]) == ["most", "last"]
    assert seen and max(seen) <= 20


def test_without_a_key(spark):
    twice = spark.range(300).union(spark.range(300)).selectExpr("id AS a", "id % 7 AS b")
    assert keys.find_key(twice, ["a", "b"]) is None
    assert keys.find_key(twice.where("a < 0"), ["a", "b"]) is None
    assert keys.find_key(twice, []) is None
    assert keys.find_key(spark.range(1), ["id"]) == ["id"]
    # A single repeated row is enough where all must differ, and nothing where 95 % must.
    once = spark.range(400).selectExpr("id % 20 AS x", "id div 20 AS y")
    almost = once.union(once.limit(1))
    assert keys.find_key(almost, ["x", "y"]) is None and keys.find_key(almost, ["x", "y"], 0.95) == ["x", "y"]


def test_nulls_are_values(spark):
    df = spark.sql("select * from values (null, 1), (1, null), (null, null), (1, 1) t(a, b)")
    assert keys.find_key(df, ["a", "b"]) == ["a", "b"]
    assert keys.sketched(df, [("a", "b"), ("a",)]) == {("a", "b"): 4, ("a",): 2}


def test_repeated_rows(spark):
    rows = [(i % 40 if i < 300 else None, i % 3, i) for i in range(400)] + [(1000, 1, 1)]
    df = spark.createDataFrame(rows, "k int, j int, i int")
    pairs = [r[:2] for r in rows]
    want = sorted((r for r in rows if pairs.count(r[:2]) > 1), key=repr)
    assert sorted(map(tuple, keys.repeated_rows(df, ["k", "j"]).collect()), key=repr) == want


def test_fields_that_record_when_come_last(spark):
    i = F.col("id")
    t = {"log": spark.range(400).select((i % 20).alias("place"), (i % 4).alias("kind"), (i / 20).cast("int").cast("string").alias("created_at"))}
    found = relations.primary_keys(t, profile_fields(analyze.counts_of(t), analyze.row_counts(t)))
    assert found == {"log": ["place", "created_at"]}
