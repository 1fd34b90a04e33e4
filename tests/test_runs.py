"""Drift of a run against stored runs: modes, bands, schema events, values, privacy."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vitalframe.functions import scores
from vitalframe.operators import drift, profile, runs
from vitalframe.plans import analyze
from vitalframe.session import settle
from vitalframe.sinks import history

METRIC = "metric string, object string, path string, value double"
PAST = "tag string, run_date string, metric string, object string, path string, value double, breached boolean"


def by_kind(rows):
    return {(r["kind"], r["object"], r["path"]): r for r in rows}


def test_quantile_psi_equals_the_formula(spark):
    rnd = random.Random(7)
    made = [sorted(rnd.choice([rnd.gauss(0, 3), float(rnd.randrange(4)), 5.0]) for _ in range(21)) for _ in range(40)]
    made += [[0.0] * 21, [float(i) for i in range(21)], [1.0] * 20 + [2.0]]
    pairs = [(rnd.choice(made), rnd.choice(made)) for _ in range(150)]
    got = [r[0] for r in spark.createDataFrame(pairs, "a array<double>, b array<double>").coalesce(1).select(runs.quantile_psi(F.col("a"), F.col("b"))).collect()]
    table = lambda q: {f"p{5 * i}": v for i, v in enumerate(q)}
    assert got == pytest.approx([scores.numeric_psi(table(a), table(b)) for a, b in pairs], abs=2e-4)


def band(values, k, floor, rel, low, high):
    m = statistics.median(values)
    sigma = max(1.4826 * statistics.median(abs(v - m) for v in values), floor, rel * abs(m)) or 1e-9
    lower, upper = min(m - k * sigma, min(values) - rel * abs(min(values))), max(m + k * sigma, max(values) + rel * abs(max(values)))
    return m, sigma, max(lower, low), min(upper, high)


def test_bands_of_random_series(spark):
    rnd = random.Random(8)
    past, current, want = [], [], {}
    inf = float("inf")
    for i in range(30):
        metric = rnd.choice(["row_count", "coverage", "dqi", "distinct", "orphan_pct"])
        path = f"f{i}"
        values = [(t, float(rnd.randrange(90, 101)), rnd.random() < 0.3) for t in range(rnd.randrange(20))]
        now = float(rnd.choice([0, 60, 95, 99, 100, 140 if metric in ("row_count", "distinct") else 100]))
        past += [(f"r{t:02}", f"2024-01-{t + 1:02}", metric, "o", path, v, b) for t, v, b in values]
        current.append((metric, "o", path, now))
        kept = [v for _, v, b in values if not b][-14:]
        if len(kept) < 3:
            want[path] = "cold"
            continue
        se = scores.proportion_se_pts(sorted(kept)[len(kept) // 2], 50)
        floor = 1.0 if metric in ("row_count", "distinct") else se if metric == "coverage" else 0.0
        m, sigma, lower, upper = band(kept, 3.0, floor, 0.05, 0.0, inf if metric in ("row_count", "distinct") else 100.0)
        want[path] = "ok" if lower <= now <= upper else "fail" if abs(now - m) / sigma > 3 else "warn"
    current.append(("sampled", "o", "", 50.0))
    got = runs.scored_by_bands(spark.createDataFrame(current, METRIC), spark.createDataFrame(past, PAST), drift.Rules())
    assert {r["path"]: r["severity"] for r in got.collect()} == want and len(set(want.values())) >= 3


def test_rolling_falls_back_and_keeps_set_rules(spark):
    past = [(f"r{t}", f"2024-01-0{t + 1}", "row_count", o, "", v, False) for t in range(5) for o, v in (("steady", 100.0), ("set", 100.0))]
    past.append(("r4", "2024-01-05", "row_count", "young", "", 100.0, False))
    last = spark.createDataFrame([("row_count", o, "", 100.0) for o in ("steady", "set", "young")], METRIC)
    now = spark.createDataFrame([("row_count", o, "", 88.0) for o in ("steady", "set", "young")], METRIC)
    rules = drift.Rules({"objects": {"set": {"row_count": {"drop_pct": {"warn": 5}, "drop_message": "{object} lost {delta_pct}, {what}", "message": "no"}}}, "rolling": {"rel_floor": 0.1}})
    got = {(r["object"], r["scope"]): r for r in runs.rolling_findings(now, spark.createDataFrame(past, PAST), last, rules).collect()}
    assert {k: r["severity"] for k, r in got.items()} == {("set", "object"): "warn", ("young", "builtin"): "warn"}
    assert got["set", "object"]["message"] == "{object} lost {delta_pct}, {what}"  # a name it does not know: as given
    assert got["young", "builtin"]["message"] == "young: row count fell from 100 to 88 (-12.0%)."
    now = now.withColumn("value", F.lit(20.0))
    got = {(r["object"], r["scope"]): r["severity"] for r in runs.rolling_findings(now, spark.createDataFrame(past, PAST), last, rules).collect()}
    assert got["steady", "rolling"] == "fail" and ("steady", "builtin") not in got and got["set", "object"] == "warn" and got["set", "rolling"] == "fail"


def a_run(spark, day, drop=(), n=400, kinds=("a", "b", "c"), shift=0.0):
    i = F.col("id")
    df = spark.range(n).select(
        i.alias("event_id"), F.element_at(F.array(*map(F.lit, kinds)), (i % len(kinds) + 1).cast("int")).alias("kind"), ((i * 37 % 100) + shift).alias("amount"),
        F.date_add(F.lit("1950-03-01").cast("date"), (i % 200).cast("int")).cast("string").alias("date_of_birth"), F.concat(F.lit("user"), i, F.lit("@example.com")).alias("contact_email"), F.lit("x").alias("extra"),
    )
    return {"t": df.drop(*drop)}


def stored(spark, tables, personal=()):
    """A run's stored tables, without the rest of an analysis."""
    counts = analyze.counts_of(tables)
    p = settle(profile.fields(counts, analyze.row_counts(tables)))
    kept = settle(runs.stored_profile(counts, p, spark.createDataFrame(list(personal), "object string, path string, masked string"), spark.createDataFrame([], "object string, path string")))
    size = p.groupBy("object").agg(F.max("rows").cast("double").alias("value")).select(F.explode(F.array(F.lit("row_count"), F.lit("sampled"))).alias("metric"), "object", F.lit("").alias("path"), "value")
    return runs.Stored(settle(size.union(p.select(F.lit("coverage"), "object", "path", "coverage"))), kept, settle(runs.kept_categories(counts, kept)))


def compared(now, past, rules=None):
    return by_kind(runs.findings(now, past, rules).collect())


def test_modes_over_history(spark, tmp_path):
    h = history.History(spark, str(tmp_path / "h"))
    assert h.past("rolling") is None
    # "d" is seen on the second day only, "extra" misses the third and comes and goes.
    for k, (drop, kinds) in enumerate([((), "abc"), ((), "abd"), (("extra",), "abc"), ((), "abc")], 1):
        h.save_run(f"r{k}", f"2024-01-0{k}", stored(spark, a_run(spark, k, drop, kinds=tuple(kinds))))
    past = h.past("rolling", "r5", "2024-01-05")
    assert past.tag == "r4" and past.recent == ["r4", "r3", "r2", "r1"]
    got = compared(stored(spark, a_run(spark, 5, ("extra", "contact_email"), kinds=("a", "b", "d"), shift=60.0)), past)
    assert got["field_removed", "t", "extra"]["severity"] == "info" and "3 of the last 4" in got["field_removed", "t", "extra"]["message"]
    assert got["field_removed", "t", "contact_email"]["severity"] == "fail"
    assert ("categories_new", "t", "kind") not in got and got["categories_vanished", "t", "kind"]["severity"] == "warn"
    assert got["distribution", "t", "amount"]["severity"] == "fail" and "mean" in got["distribution", "t", "amount"]["message"]
    got = compared(stored(spark, a_run(spark, 5, kinds=("a", "b", "d"))), h.past("previous", "r5", "2024-01-05"))
    assert got["categories_new", "t", "kind"]["severity"] == "warn" and "d" in got["categories_new", "t", "kind"]["message"]
    base = h.past("baseline:R3")
    got = compared(stored(spark, a_run(spark, 5, n=200)), base)
    assert got["field_added", "t", "extra"]["severity"] == "info" and got["row_count", "t", ""]["severity"] == "fail"
    with pytest.raises(ValueError):
        h.past("baseline:none")
    with pytest.raises(ValueError):
        h.past("sometimes")


def test_personal_values_are_not_stored(spark, tmp_path):
    """No table of a stored run holds a raw value of a masked field."""
    run = analyze.analyze(a_run(spark, 1), "2024-01-01")
    masked = {(f["object"], f["field"]) for f in run.pii["fields"] if f["confidence"] >= analyze.MASK_CONFIDENCE}
    assert {("t", "date_of_birth"), ("t", "contact_email")} <= masked
    history.History(spark, str(tmp_path / "h")).save_run("r", "2024-01-01", run.stored, run.findings)
    for table in history.TABLES:
        rows = spark.read.parquet(str(tmp_path / "h" / table))
        text = " ".join(str(r) for r in rows.where("path in ('date_of_birth', 'contact_email')").collect()) if "path" in rows.columns else ""
        assert "1950" not in text and "@example.com" not in text and "datetime" not in text.replace("run_date", "") or table == "metrics"
    kept = {r["path"]: r for r in run.stored.profile.collect()}
    assert kept["date_of_birth"]["first_date"] is None and kept["date_of_birth"]["sketch"] is None and kept["date_of_birth"]["masked"] == "date_of_birth"
    assert kept["amount"]["quantiles"] is not None and not kept["amount"]["skip"] and kept["event_id"]["skip"]
    assert {r["path"] for r in run.stored.categories.select("path").distinct().collect()} == {"kind", "extra"}


def test_new_personal_field_warns_and_rules_bind_by_field(spark):
    old = stored(spark, a_run(spark, 1, ("contact_email",)))
    rules = drift.Rules({"objects": {"t": {"fields": {"ext*": {"schema": {"field_removed": "warn"}}, "kind": {"categories": {"new": "fail"}, "distribution": {"psi_warn": 99, "psi_fail": 99}}}}}})
    got = compared(stored(spark, a_run(spark, 2, ("extra",), kinds=("a", "z")), [("t", "contact_email", "email")]), runs.Past(old), rules)
    assert got["field_added", "t", "contact_email"]["severity"] == "warn" and "personal data" in got["field_added", "t", "contact_email"]["message"]
    assert got["field_removed", "t", "extra"]["severity"] == "warn" and got["field_removed", "t", "extra"]["scope"] == "field"
    assert got["categories_new", "t", "kind"]["severity"] == "fail" and ("distribution", "t", "kind") not in got


def test_type_change_share_objects_and_sketched_renames(spark):
    i = F.col("id")
    old = {"o": spark.range(300).select(F.lit("word").alias("n"), (i % 90).alias("size_a"), F.lit("x").alias("s")), "gone": spark.range(3)}
    new = {"o": spark.range(300).select(F.when(i % 4 == 0, "2024-01-01").otherwise("word").alias("n"), (i % 90).alias("size_b"), F.lit("x").alias("s")), "come": spark.range(3)}
    got = compared(stored(spark, new), runs.Past(stored(spark, old)))
    assert got["object_added", "come", ""]["severity"] == "info" and got["object_removed", "gone", ""]["severity"] == "fail"
    assert ("field_renamed", "o", "size_a -> size_b") in got and ("field_removed", "o", "size_a") not in got
    changed = got["type_changed", "o", "n"]
    assert changed["new"] == pytest.approx(25.0) and "25.0%" in changed["message"]


def test_nothing_to_compare(spark):
    run = stored(spark, a_run(spark, 1))
    assert compared(run, runs.Past()) == {} and compared(run, runs.Past(run)) == {}
