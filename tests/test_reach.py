"""Value counts are put in order, and meet, without moving what can't matter."""

import pytest
from pyspark.sql import functions as F
from vitalframe.operators import profile, relations, runs
from vitalframe.plans import analyze

ROWS = 60_000


@pytest.fixture(scope="module")
def kept(spark):
    a = spark.range(ROWS).select(F.col("id").alias("a_id"), (F.col("id") % 3000).alias("b_id"), F.when(F.col("id") < 30, "hot").otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("name"), (F.col("id") / 7).alias("x"))
    b = spark.range(3000).select(F.col("id").alias("b_id"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("label"))
    tables = {"a": a, "b": b}
    plain = analyze.counts_of(tables)
    # One value of two types: neither row's count is the value's.
    for kind, n in (("int", 700), ("string", 800)):
        plain = plain.unionByName(spark.createDataFrame([("a", "name", kind, "twice", None, n, 0, n)], plain.schema))
    counts = plain.withColumn("run", F.lit("reach")).drop("run").persist()
    yield counts, plain, profile.fields(counts, analyze.row_counts(tables)).persist()
    counts.unpersist()


def _last(filled):
    part = filled.where(F.pmod(F.xxhash64("value"), F.lit(profile.PART)) == 0)
    w = profile.Window.partitionBy("object", "path").orderBy(F.desc("n"), "value")
    return part.withColumn("rank", F.row_number().over(w)).where("rank = 7")


def test_first_values_without_ordering_all(kept):
    counts, plain, _ = kept
    got = [tuple(r) for r in profile.top_values(counts, 7).select("object", "path", "rank", "value", "n").sort("object", "path", "rank").collect()]
    assert got == [tuple(r) for r in profile.top_values(plain, 7).select("object", "path", "rank", "value", "n").sort("object", "path", "rank").collect()]
    assert ("a", "name", 1, "twice", 1500) in got and ("a", "name", 2, "hot", 30) in got
    filled = counts.where("value is not null")
    last = _last(filled)
    left = {r["path"]: r["count"] for r in profile._in_reach(filled, last).groupBy("path").count().collect()}
    assert left["a_id"] < ROWS / 2 and left["name"] > ROWS - 40


def test_references_move_values_once(kept):
    counts, _, p = kept
    refs = relations.references(counts, p)
    got = {(r["child"], r["child_path"], r["parent"], r["parent_path"]): (r["child_occurrences"], r["orphan_occurrences"], r["orphan_distinct"]) for r in refs.collect()}
    assert got["a", "b_id", "b", "b_id"] == (ROWS, 0, 0)
    plan = refs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [x for x in plan if "Join" in x and "value#" in x]  # values meet by one order, not by a join of two
    assert len([x for x in plan if "Window [collect_list" in x and "value#" in x]) == 1


def test_least_hashes_of_many_values(kept, spark):
    counts, _, p = kept
    none = spark.createDataFrame([], "object string, path string, masked string")
    stored = runs.stored_profile(counts, p, none, none.select("object", "path"))
    got = stored.where("object = 'a' and path = 'name'").first()["sketch"]
    want = counts.where("object = 'a' and path = 'name' and value is not null").select(F.xxhash64("value").alias("h")).distinct().sort("h").limit(runs.SKETCH)
    assert got == [r["h"] for r in want.collect()]
    assert [x for x in stored._jdf.queryExecution().optimizedPlan().toString().splitlines() if "__most" in x and "Filter" in x]
