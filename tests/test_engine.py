"""Fixtures with known answers, for each part of the engine."""

import datetime
import gzip
import json
import random
import statistics
import zipfile

import pytest
from pyspark.sql import functions as F

from vitalframe import cli
from vitalframe.functions import names, privacy, scores
from vitalframe.functions.values import string_type
from vitalframe.operators import compare, contract, drift, filters, profile, quality, relations, sampling, walk
from vitalframe.plans import analyze, decide
from vitalframe.sinks import history, notify, report
from vitalframe.sources import connections, files, registry, rest, tables


def profiled(t):
    counts = profile.value_counts(analyze.nodes_of(t))
    return counts, profile.fields(counts, analyze.row_counts(t))


def facts(p):
    return {(r["object"], r["path"]): r for r in p.collect()}


@pytest.fixture(scope="module")
def league(spark):
    players = spark.range(300).select(F.format_string("p%04d", "id").alias("player_id"), F.concat(F.lit("Player "), "id").alias("name"), F.concat(F.lit("player"), "id", F.lit("@example.com")).alias("contact_email"))
    i = F.col("id")
    events = spark.range(3000).select(
        F.format_string("e%05d", "id").alias("event_id"), F.format_string("p%04d", i % 300).alias("batter_id"), F.format_string("p%04d", (i + 7) % 300).alias("non_striker_id"),
        F.when(i < 2940, F.format_string("p%04d", (i * 3) % 300)).otherwise(F.concat(F.lit("zz"), i)).alias("bowler_id"), (i % 7).alias("runs"),
    )
    return {"players": players, "events": events}


# ---------------------------------------------------------------- profile and walk


def test_league_profile_and_links(spark, league):
    run = analyze.analyze(league, "2024-01-01")
    f = facts(run.profile)
    assert f["events", "event_id"]["distinct"] == 3000 and f["events", "batter_id"]["coverage"] == 100
    assert run.keys["events"] == ["event_id"] and run.keys["players"] == ["player_id"]
    links = {(r["child"], r["child_path"]): r for r in run.references.where("rank = 1").collect()}
    assert links["events", "batter_id"]["orphan_pct"] == 0
    assert abs(links["events", "bowler_id"]["orphan_pct"] - 2.0) < 1e-9 and links["events", "bowler_id"]["orphan_distinct"] == 60
    emails = [r["value"] for r in run.masked_values().where("path = 'contact_email'").collect()]
    assert emails == ["p***@example.com"]
    pairs = relations.same_values(run.counts.where("object = 'events'"), run.profile.where("object = 'events'")).collect()
    assert ("batter_id", "non_striker_id") in {(r["field_a"], r["field_b"]) for r in pairs}
    d = {(r["field_a"], r["field_b"]): r["kind"] for r in relations.duplicates(league["events"], [(r["field_a"], r["field_b"], r["jaccard"], 1.0) for r in pairs]).collect()}
    assert d["batter_id", "non_striker_id"] == "shared_domain"
    assert run.health["status"] in ("healthy", "attention") and run.actions[0]["id"] == "A01"
    assert report.graph([r.asDict() for r in run.references.where("rank = 1").collect()]).startswith("graph LR")


def test_missing_is_not_null(spark):
    lines = ['{"id": %d, "speed": %s, "note": "%s"}' % (i, i if i % 10 == 0 else "null", "" if i % 2 else "x") for i in range(200)] + ['{"id": %d}' % i for i in range(200, 250)]
    v = spark.createDataFrame([(x,) for x in lines], "j string").select(F.parse_json("j").alias("v"))
    counts = profile.value_counts(walk.variant_nodes(v, "balls"))
    f = facts(profile.fields(counts, v.agg(F.lit("balls").alias("object"), F.count("*").alias("rows"))))
    assert f["balls", "speed"]["coverage"] == 8.0 and f["balls", "speed"]["presence"] == 200
    assert f["balls", "note"]["filled"] == 100 and f["balls", "id"]["coverage"] == 100


def test_variant_and_typed_walk_agree(spark):
    docs = ['{"a":{"b":1,"c":"x"},"w":[{"k":"p"},{"k":""}],"t":[1,2]}', '{"a":{"b":2,"c":""},"w":[{"k":"q"}],"t":[]}', '{"a":null,"w":[],"t":[3]}']
    raw = spark.createDataFrame([(d,) for d in docs], "j string")
    typed = raw.select(F.from_json("j", "a struct<b:long,c:string>, w array<struct<k:string>>, t array<long>").alias("r")).select("r.*")
    cols = ("path", "type", "value", "present", "empty")
    count = lambda n: sorted(map(str, n.where("type != 'null' or path != 'a'").groupBy("path", "type", "value").agg(F.count("*").alias("n")).where("path not in ('a.b', 'a.c') or type != 'null'").collect()))
    a, b = count(walk.typed_nodes(typed, "d").select(*cols)), count(walk.variant_nodes(raw.select(F.parse_json("j").alias("v")), "d").select(*cols))
    assert a == b
    once = lambda n: {r["path"]: (r["p"], r["e"]) for r in n.groupBy("path").agg(F.sum("present").alias("p"), F.sum("empty").alias("e")).where("path like '%[]%' or path in ('w', 't')").collect()}
    assert once(walk.typed_nodes(typed, "d")) == once(walk.variant_nodes(raw.select(F.parse_json("j").alias("v")), "d"))


def test_profile_does_not_depend_on_partitions(spark, league):
    one = facts(profiled(league)[1])
    many = facts(profiled({k: v.repartition(13) for k, v in league.items()})[1])
    assert one == many


def test_types(spark):
    cases = {"": "string", "https://a.b": "url", "s3://x": "uri", "a@b.co": "email", "0" * 8 + "-0000-0000-0000-" + "0" * 12: "uuid", "2024-01-02 later": "date", "+1 555 010 9999": "phone", "1234567890": "numeric_id", "plain": "string"}
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", string_type(F.col("s")).alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def test_names():
    assert names.is_identifier("orderId") and not names.is_identifier("video") and not names.is_identifier("company")
    assert "firstname" in names.tokens("first_name") and names.is_audit("createdAt") and names.identifier_bias("o_orderkey") == 2.0
    assert names.useless_for_joins("status") and not names.useless_for_joins("batter_id")


def test_pii(spark):
    hints = spark.createDataFrame(privacy.name_hints([("o", f) for f in ("email", "company", "name", "tel", "first_name")]), privacy.HINTS)
    shown = spark.createDataFrame([("o", "email", "email", 1.0), ("o", "code", "phone", 0.5), ("o", "tel", "phone", 0.2), ("o", "tel", "ssn", 0.4)], "object string, field string, type string, ratio double")
    got = {(r["field"], r["type"]): (round(r["confidence"], 6), r["method"], r["high_risk"]) for r in privacy.detections(hints, shown).collect()}
    assert got == {
        ("email", "email"): (0.99, "name+value", True), ("name", "name"): (0.4, "name", False), ("first_name", "name"): (0.75, "name", False),
        ("code", "phone"): (0.725, "value", False), ("tel", "phone"): (0.75, "name", False), ("tel", "ssn"): (0.68, "value", False),
    }
    values = [("phone", "+1 555-010-1234"), ("phone", "12"), ("email", "ann@x.org"), ("email", "none"), ("credit_card", "4111 1111 1111 1234"), ("ip_address", "10.1.2.3"), ("name", " Ann  Lee "), ("name", " "), ("address", "ab"), ("address", "abcd"), ("ssn", "1"), ("ssn", None)]
    rows = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(values)], "i int, k string, v string")
    masked = F.lit(None).cast("string")
    for k in {k for k, _ in values}:
        masked = F.when(F.col("k") == k, privacy.mask(F.col("v"), k)).otherwise(masked)
    assert [r["m"] for r in rows.select("i", masked.alias("m")).orderBy("i").collect()] == ["***-***-1234", "***-***-****", "a***@x.org", "***@***.***", "****-****-****-1234", "10.***.***.**", "A*** L***", "***", "**", "a**d", "***-**-****", "***"]
    assert privacy.scrub("mail bob@x.org now", ["bob@x.org", "x"]) == "mail *** now"


# ---------------------------------------------------------------- drift


def test_psi_math():
    same = {f"p{q}": float(q) for q in range(0, 101, 5)}
    moved = {f"p{q}": float(q) + 40 for q in range(0, 101, 5)}
    assert scores.numeric_psi(same, same) < 0.1 < 0.25 < scores.numeric_psi(same, moved)
    assert scores.psi([0.5, 0.5], [0.5, 0.5]) == 0 and scores.psi_noise(3, 0, 5) == float("inf")
    assert scores.grade(90) == "A" and scores.grade(59) == "F"


def test_rolling_band_columns_match(spark):
    past = [250.0, 500.0, 248.0, 251.0, 497.0, 252.0, 249.0, 502.0, 40.0]
    df = spark.createDataFrame([(i, v, False) for i, v in enumerate(past)], "i int, value double, breached boolean").withColumn("k", F.lit("x"))
    got = {r["i"]: r for r in drift.rolling_bands(df, "i", ["k"]).collect()}
    middle = statistics.median(past[:7])
    sigma = max(1.4826 * statistics.median(abs(v - middle) for v in past[:7]), 0.05 * middle)
    want = {"lower": min(middle - 3 * sigma, 0.95 * 248), "upper": max(middle + 3 * sigma, 1.05 * 500)}
    assert got[7]["lower"] == pytest.approx(want["lower"]) and got[7]["upper"] == pytest.approx(want["upper"]) and got[7]["severity"] == "ok"
    assert got[8]["severity"] == "fail" and got[1]["severity"] == "cold"
    left_out = df.withColumn("breached", F.col("i").isin(1, 4))
    assert {r["i"]: r["n"] for r in drift.rolling_bands(left_out, "i", ["k"]).collect()}[7] == 5


def test_bands_over_kept_points_of_random_series(spark):
    rnd = random.Random(12)
    rows = [(k, i, float(rnd.randrange(100)), rnd.random() < 0.4) for k in "ab" for i in range(60)]
    got = drift.rolling_bands(spark.createDataFrame(rows, "k string, i int, value double, breached boolean"), "i", ["k"], window=5).collect()
    for r in got:
        kept = [v for k, i, v, b in rows if k == r["k"] and i < r["i"] and not b][-5:]
        assert r["n"] == len(kept) and r["median"] == (statistics.median(kept) if kept else None)


def test_as_of_takes_the_newest_run_far_enough_back(spark):
    first = datetime.date(2024, 1, 1)
    runs_ = [(f"r{i}", first + datetime.timedelta(days=d)) for i, d in enumerate((0, 0, 1, 3, 8, 9, 40))]
    got = {(r["tag"], r["days"]): r["ref_tag"] for r in drift.as_of(spark.createDataFrame(runs_, "tag string, day date"), (0, 1, 7)).collect()}
    for tag, day in runs_:
        for n in (0, 1, 7):
            old = [(d, t) for t, d in runs_ if d <= day - datetime.timedelta(days=n)]
            assert got[tag, n] == (max(old)[1] if old else None)
    assert len(got) == 21


def test_rules_scopes(spark):
    r = drift.Rules({"defaults": {"coverage": {"drop_pct": {"warn": 1, "fail": 50}}}, "objects": {"orders*": {"row_count": {"drop_pct": 5}, "fields": {"addr.*": {"coverage": {"drop_pts": 2}}}}}})
    changes = [("row_count", "orders_eu", "", 100.0, 94.0), ("coverage", "orders", "addr.city", 100.0, 97.0), ("coverage", "other", "x", 100.0, 97.0), ("row_count", "other", "", 100.0, 95.0)]
    df = spark.createDataFrame(changes, "metric string, object string, path string, old double, new double")
    got = {(x["metric"], x["object"]): (x["severity"], x["direction"], x["threshold"], x["scope"]) for x in drift.bind_rules(df, r.frame(spark)).collect()}
    assert got["row_count", "orders_eu"] == ("fail", "drop", "drop_pct >= 5", "object")
    assert got["coverage", "orders"] == ("fail", "drop", "drop_pts >= 2", "field")
    assert got["coverage", "other"][::3] == ("warn", "dataset") and got["row_count", "other"][::3] == ("ok", "builtin")
    assert {x["scope"] for x in r.listed()} == {"builtin", "dataset", "object", "field"}


def test_drift_between_runs(spark, league):
    before = analyze.analyze(league, "2024-01-01")
    changed = league["events"].where("id is null" if "id" in league["events"].columns else "event_id < 'e01500'").withColumn("runs", F.when(F.col("runs") == 6, 99).otherwise(F.col("runs"))).drop("non_striker_id")
    after = analyze.analyze({"players": league["players"], "events": changed}, "2024-01-01", reference=before)
    kinds = {(f["kind"], f["path"]): f["severity"] for f in after.findings}
    assert kinds["field_removed", "non_striker_id"] == "fail" and kinds["row_count", ""] == "fail"
    assert kinds["categories_new", "runs"] in ("warn", "info") and ("categories_vanished", "runs") in kinds and kinds["distribution", "runs"] == "fail"
    assert after.health["score"] < before.health["score"] and after.findings[0]["severity"] == "fail"


def test_renames(spark):
    i = F.col("id")
    old = spark.range(100).select(i, (i % 7).alias("amount"), (i % 5).cast("string").alias("kind"), F.struct((i % 3).alias("a")).alias("s"))
    new = spark.range(100).select(i, (i % 8).alias("amount_usd"), (i % 5).alias("other"), F.struct((i % 3).alias("b")).alias("s"), (i % 3).alias("a"))
    (oc, op), (nc, np_) = profiled({"o": old}), profiled({"o": new})
    got = drift.renames(compare.profile_diff(op, np_), oc, nc).collect()
    assert {(r["old_path"], r["new_path"]) for r in got} == {("amount", "amount_usd"), ("s.a", "s.b")}
    run = analyze.analyze({"o": new}, "2024-01-01", reference=analyze.analyze({"o": old}, "2024-01-01"))
    kinds = {(f["kind"], f["path"]) for f in run.findings}
    assert ("field_renamed", "amount -> amount_usd") in kinds and ("field_removed", "kind") in kinds and ("field_added", "a") in kinds


def test_composite_keys(spark):
    i = F.col("id")
    t = {"lines": spark.range(600).select((i / 6).cast("int").alias("order_id"), (i % 6).alias("line"), (i % 4).alias("q"))}
    assert relations.primary_keys(t, profiled(t)[1]) == {"lines": ["order_id", "line"]}
    t = {"flat": spark.range(50).select(i, (i % 2).alias("q"))}
    assert relations.primary_keys(t, profiled(t)[1]) == {"flat": ["id"]}


def test_walks_agree_on_nested_records(spark):
    df = spark.sql("select id, array(named_struct('a', named_struct('b', id), 'ys', array(1, 2)), named_struct('a', null, 'ys', array(3))) xs, map('k', cast(id as int)) m, array(array(1), array(2, 3)) aa, transform(sequence(1, 150), x -> x) many from range(5)")
    v = df.select(F.parse_json(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("v"))
    of = lambda nodes: sorted(map(tuple, nodes.groupBy("path").agg(F.sum("present"), F.sum("empty"), F.count("*"), F.countDistinct("value")).collect()))
    typed = of(walk.typed_nodes(df, "t"))
    assert typed == of(walk.variant_nodes(v, "t"))
    assert {p for p, *_ in typed} == {"id", "xs", "xs[].a", "xs[].a.b", "xs[].ys", "xs[].ys[]", "m", "m.k", "aa", "aa[]", "aa[][]", "many", "many[]"}
    assert dict((p, n) for p, _, _, n, _ in typed)["many[]"] == 750


def test_flat_counts_equal_nodes(spark):
    """Both ways to count scalar columns give the same rows."""
    df = spark.sql("select id, if(id % 3 = 0, null, cast(id as double) / 4) d, if(id = 1, double('nan'), 1.5D) e, cast(id % 2 as boolean) b, timestamp '2024-01-01 00:00:00.5' + make_interval(0, 0, 0, cast(id as int)) t, date '2024-01-02' dt, cast(id as decimal(10, 2)) m, if(id % 2 = 0, '', 'x@y.org') s, cast('ab' as binary) raw, repeat('long ', 200) txt from range(9)")
    rows = lambda c: sorted(map(repr, c.select("path", "type", "value", "number", "present", "empty", "n").collect()))
    assert rows(walk.flat_counts({"t": df})) == rows(profile.value_counts(walk.typed_nodes(df, "t")))


# ---------------------------------------------------------------- contracts and records


def test_contract(spark):
    i = F.col("id")
    orders = spark.range(200).select(
        F.concat(F.lit("o"), i).alias("id"), F.when(i % 10 == 0, None).otherwise(F.concat(F.lit("t"), i)).alias("title"), F.when(i == 5, "lost").when(i % 3 > 0, "paid").otherwise("open").alias("status"),
        F.when(i == 6, -1).otherwise(i % 5).alias("qty"), F.lit("IN").alias("country"), F.struct(F.lit("web").alias("channel")).alias("meta"),
    )
    schema = {"type": "object", "required": ["id", "title", "status", "sku"], "additionalProperties": False, "properties": {"id": {"type": "string"}, "title": {"type": "string"}, "status": {"type": "string", "enum": ["paid", "open"]}, "sku": {"type": "string"}, "qty": {"type": "integer", "minimum": 0}, "meta": {"type": "object"}}}
    counts, p = profiled({"orders": orders})
    got = {(c["field"], c["check"]): c["status"] for c in contract.checks(p, counts, [contract.parse(schema, "orders")])}
    fails = {k for k, v in got.items() if v == "fail"}
    assert fails == {("sku", "required"), ("title", "required"), ("status", "enum"), ("qty", "range")}
    assert got["country", "unexpected_fields"] == "warn" and got["id", "type"] == "pass"
    made = contract.infer(p, counts)["objects"]["orders"]
    assert made["properties"]["status"]["enum"] == ["lost", "open", "paid"] and "id" in made["required"] and "title" not in made["required"]
    assert made["properties"]["meta"]["properties"]["channel"]["type"] == "string" and "minimum" not in made["properties"]["qty"]
    again = contract.checks(p, counts, [contract.parse(made, "orders")])
    assert contract.summary(again)["summary"]["fail"] == 0


def test_record_changes(spark):
    schema = "id string, v struct<a:int,tags:array<string>>, xs array<struct<k:int>>"
    a = spark.createDataFrame([("1", (1, ["x", "y"]), [(1,)]), ("2", (2, []), [(5,)]), ("3", None, None)], schema)
    b = spark.createDataFrame([("1", (1, ["y", "x"]), [(1,)]), ("2", (None, ["z"]), [(6,)]), ("4", None, None)], schema)
    got = {(r["k"], r["kind"], r["field"]) for r in compare.record_changes(a, b, ["id"]).collect()}
    assert got == {("2", "value_to_null", "v.a"), ("2", "null_to_value", "v.tags"), ("2", "modified", "xs[].k"), ("3", "only_in_1", None), ("4", "only_in_2", None)}
    x, y = compare.sampled_pair(a, b, ["id"], 2)
    assert x.union(y).select("id").distinct().count() == 2


# ---------------------------------------------------------------- filters, sandbox, sampling


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a", ["x"]), (2, None, ["y", "z"]), (3, "c", [])], "n int, s string, t array<string>")
    ids = lambda q: sorted(r["n"] for r in df.where(filters.predicate(q, df.schema)).collect())
    assert ids({"s": {"$exists": False}}) == [2] and ids({"t": {"$in": ["z", "x"]}}) == [1, 2] and ids({"t": {"$nin": ["x"]}}) == [2, 3]
    assert ids({"n": {"$gt": 1, "$lte": 3}, "s": {"$ne": "c"}}) == [2] and ids({"s": "a"}) == [1] and ids({"s": {"$in": []}}) == []


def test_expressions():
    assert filters.evaluate("1 < x <= 3 and not y or 'a' in z", {"x": 2, "y": False, "z": ["a"]})
    for bad in ("__import__('os')", "x.y", "(lambda: 1)()", "[i for i in x]", "9**9**9", "'a' * 10", "unknown"):
        with pytest.raises(filters.UnsafeExpression):
            filters.evaluate(bad, {"x": 1})
        assert not filters.holds(bad, {"x": 1})


def test_sandbox(spark):
    users = spark.range(120).select(F.concat(F.lit("u"), "id").alias("user_id"), F.struct(F.when(F.col("id") % 2 == 1, "Pune").otherwise("Delhi").alias("city")).alias("address"))
    view = {"users": filters.flatten(users)}
    got = filters.run_query(view, "SELECT `address.city` AS city, count(*) AS n FROM users GROUP BY 1 ORDER BY 1", deadline_s=60)
    assert got["rows"] == [{"city": "Delhi", "n": 60}, {"city": "Pune", "n": 60}] and not got["truncated"]
    assert filters.run_query(view, "SELECT * FROM users", max_rows=5, deadline_s=60)["truncated"]
    for bad in ("DROP TABLE users", "INSERT INTO users SELECT 1", "SELECT 1; SELECT 2", "SET a=b", "CREATE VIEW v AS SELECT 1", "SELECT * FROM parquet.`/etc`", "SELECT reflect('java.lang.System', 'exit')", "WITH a AS (SELECT 1) INSERT INTO users SELECT * FROM a"):
        with pytest.raises(filters.RejectedQuery):
            filters.run_query(view, bad)


def test_sampling(spark):
    df = spark.range(1000)
    a = {r["id"] for r in sampling.select(df, 50, "reservoir", ["id"]).collect()}
    assert len(a) == 50 and a == {r["id"] for r in sampling.select(df.repartition(9), 50, "reservoir", ["id"]).collect()}
    assert sampling.select(df, 0).count() == 1000 and [r["id"] for r in sampling.tail(df, 2, ["id"]).collect()] == [999, 998]
    assert sampling.head(df, 3).count() == 3 and sampling.blocks(df, 0.5, 10).count() == 10


# ---------------------------------------------------------------- sources


def test_files(spark, tmp_path):
    rows = [{"a": 1, "b": "x"}, {"a": "two", "c": [1]}, 5]
    text = "\n\n".join(json.dumps(r) for r in rows)
    (tmp_path / "one.jsonl").write_text(text)
    (tmp_path / "two.jsonl.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "doc.json").write_text(json.dumps({"data": {"items": rows}}))
    (tmp_path / "t.csv").write_text("name;qty\nann;1\nbob;22\n")
    (tmp_path / "skip.txt").write_text("no")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("inner.csv", "name,amount\na,1\nb,2\n")
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("a.csv", "key,amount\nx,1\n")
        z.writestr("b.csv", "key,amount\nx,2\n")
    (tmp_path / "r.xml").write_text("<root><record k='1'><a>x</a><a>y</a></record><record k='2'><a>z</a></record></root>")
    found = {d.name: d.frame for d in registry.open_source(spark, {"path": str(tmp_path)})}
    assert set(found) == {"one", "two", "doc", "t", "inner", "r"}
    assert found["one"].count() == 3 and found["two"].count() == 3
    values = sorted(r["j"] for r in found["one"].select(F.to_json("v").alias("j")).collect())
    assert '{"value":5}' in values
    assert [tuple(r) for r in found["t"].orderBy("name").collect()] == [("ann", "1"), ("bob", "22")]
    assert [tuple(r) for r in found["inner"].orderBy("name").collect()] == [("a", "1"), ("b", "2")]
    assert registry.open_source(spark, {"path": str(tmp_path / "doc.json"), "root": "data.items"})[0].frame.count() == 3
    assert registry.open_source(spark, {"path": str(tmp_path / "two.zip"), "member": "b.csv"})[0].frame.collect()[0]["amount"] == "2"
    assert found["r"].select("@attributes.k").orderBy("k").collect()[0]["k"] == "1"
    for bad in ({"path": str(tmp_path / "two.zip")}, {"path": str(tmp_path / "skip.txt")}, {"type": "nope", "path": "x"}):
        with pytest.raises(ValueError):
            registry.open_source(spark, bad)
    assert files.classify("a/b.csv.gz") == (".csv", "gzip") and files.classify("x.bin", strict=False) is None
    mixed = profile.value_counts(walk.variant_nodes(found["one"], "one")).where("path = 'a'").select("type").distinct()
    assert {r["type"] for r in mixed.collect()} == {"int", "string"}


def test_table_specs(spark):
    spark.range(10).createOrReplaceTempView("nums")
    got = {d.name: d.frame.count() for d in tables.open_tables(spark, {"objects": ["nums|id < 4 -> few", "query:SELECT id FROM nums WHERE id = 1 -> one"]})}
    assert got == {"few": 4, "one": 1}
    for bad in ("query:DROP TABLE nums", "query:SELECT 1; SELECT 2"):
        with pytest.raises(ValueError):
            tables.parse_spec(bad)


def test_rest(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    tries = {"n": 0}

    class Api(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            q = parse_qs(urlparse(self.path).query)
            tries["n"] += 1
            if tries["n"] == 1:
                self.send_response(503)
                self.end_headers()
                return
            at = int(q["offset"][0])
            body = json.dumps({"data": [{"i": i} for i in range(at, min(25, at + int(q["limit"][0])))]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Api)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/things"
    for pages in ({}, {"pages": 3}):
        d = registry.open_source(spark, {"type": "http", "uris": [url], "data_key": "data", "pagination": "offset", "size": 10, **pages})[0]
        assert d.name == "things" and d.frame.count() == 25
    server.shutdown()
    assert rest.headers({"kind": "bearer", "token": "t"}) == {"Authorization": "Bearer t"}


def test_connections(tmp_path, monkeypatch):
    (tmp_path / "db.yaml").write_text("source_type: jdbc\nparams: {url: '${DB_URL}', user: '${DB_USER:-me}'}\n")
    (tmp_path / ".env").write_text("DB_URL=jdbc:x\n")
    assert connections.load_connection(tmp_path, "db")["params"] == {"url": "jdbc:x", "user": "me"}
    assert connections.list_connections(tmp_path) == ["db"]
    assert connections.layered({"a": {"x": 1, "y": 1}}, {"a": {"y": 2}})["a"] == {"x": 1, "y": 2}
    with pytest.raises(KeyError):
        connections.substitute("${NOT_SET_ANYWHERE}", {})


# ---------------------------------------------------------------- sinks and decisions


def test_history(spark, tmp_path, league):
    run = analyze.analyze({"players": league["players"]}, "2024-01-01")
    h = history.History(spark, str(tmp_path / "runs"))
    for tag, day in (("r1", "2024-01-01"), ("Baseline", "2023-01-01"), ("r2", "2024-01-05")):
        h.save(tag, day, run.metrics, run.profile, run.masked_values().select("object", "path", "value"), [("row_count", "players", "")])
    assert [t for t, _ in h.runs()] == ["r2", "r1", "Baseline"]
    assert h.read("metrics", "r1").where("breached").count() == 1
    assert h.purge(2, "2024-01-05") == ["r1"] and [t for t, _ in h.runs()] == ["r2", "Baseline"]


def test_health_and_gates():
    h = decide.health(90.0, 2, "high", 1, 2)
    assert h["score"] == 58.0 and h["status"] == "risk"
    assert decide.health(100.0, 0, "high")["status"] == "healthy" if decide.health(100.0, 0, "high")["score"] > 80 else decide.health(100.0, 0, "high")["status"] == "attention"
    assert decide.gates({"health": 60}, "fail", "pass", "fail", {"health": 70}, {"health": 5}, {"health": 80})[0] == 2
    assert decide.gates({"health": 90}, "warn", "pass", "warn")[0] == 1 and decide.gates({"dqi": None}, least={"dqi": 1})[0] == 2
    with pytest.raises(ValueError):
        decide.parse_gates("speed=1")
    pii = privacy.summary([{"object": "o", "field": "ssn", "type": "ssn", "confidence": 0.9, "high_risk": True, "method": "name"}])
    card = decide.compliance(pii, 200)
    assert card["risk"] == "high" and card["checklist"]["masked"] == "fail" and decide.compliance(pii, 200, [("o", "ssn")])["checklist"]["masked"] == "pass" and decide.compliance(pii, 200, [("x", "ssn")])["checklist"]["masked"] == "fail"
    assert decide.fitness({"dqi": 85, "completeness": 90, "consistency": 95}) == ["ready for reporting", "ready for ml"]


def test_alerts_and_exports(tmp_path):
    numbers = notify.context({"overall_dqi": 60}, {"total_pii_fields": 1, "by_type": {"email": 1}}, [{"path": "a", "coverage": 20.0, "types": {"int": 1, "string": 1}}])
    found = notify.evaluate(numbers)
    assert {a.rule for a in found} == {"low_quality_score", "pii_detected", "low_coverage", "high_null_rate", "mixed_types"}
    at = tmp_path / "alerts.jsonl"
    assert notify.notify([f"file:{at}", "bogus:x"], found) == ["file: sent 5", "bogus: unknown target"] and len(at.read_text().splitlines()) == 5
    text = notify.prometheus([{"metric": "coverage", "object": 'o"', "path": "p", "value": 1}])
    assert 'data_health_coverage{object="o\\"",path="p"} 1.0' in text


def test_accuracy_looks_at_all_values(spark):
    """Not only at the most frequent ones, which have no shape here; texts and numbers of one form are one value."""
    rows = [(f"u{i}@mail.org",) for i in range(70)] + [(f"no mail {i}",) for i in range(30)] * 2
    run = analyze.analyze({"o": spark.createDataFrame(rows, "contact string")}, "2024-01-01")
    assert run.quality.first()["accuracy"] == pytest.approx(70.0)
    counts, p = profiled({"m": spark.createDataFrame([('{"v": 1}',), ('{"v": "1"}',), ('{"v": 2.5}',)], "j string").select(F.parse_json("j").alias("v"))})
    assert profile.distinct_values(counts, p).count() == counts.where("value is not null").select("object", "path", "value").distinct().count()


def test_quality_scores(spark):
    df = spark.range(40).select(F.lit("same").alias("s"), F.when(F.col("id") < 10, "x").alias("t"), F.col("id").cast("string").alias("id"))
    _, p = profiled({"o": df})
    q = {r["path"]: r for r in quality.field_quality(p).collect()}
    assert q["s"]["validity"] == 80 and q["t"]["validity"] == 70 and q["t"]["completeness"] == 25
    o = quality.object_quality(p, "2024-01-01").collect()[0]
    assert o["uniqueness"] == 100 and o["timeliness"] is None and 0 < o["dqi"] < 100


# ---------------------------------------------------------------- streaming and command line


def test_streaming_profile(spark, tmp_path):
    from vitalframe.streaming.windows import feed, sessions, windowed_profile

    src = tmp_path / "in"
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", None if m % 3 == 0 else "x", h) for h in range(4) for m in range(0, 60, 5)]
    spark.createDataFrame(rows, "t string, v string, k int").select(F.to_timestamp("t").alias("ts"), "v", "k").write.parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, v string, k int").parquet(str(src))
    out = []
    q = feed(windowed_profile(stream, "ts", ["v"]), lambda df, i: out.extend(df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    batch = {(r["window_start"], r["metric"]): r["value"] for r in windowed_profile(spark.read.parquet(str(src)), "ts", ["v"]).collect()}
    got = {(r["window_start"], r["metric"]): r["value"] for r in out}
    assert got and all(batch[k] == v for k, v in got.items()) and {v for (_, m), v in batch.items() if m == "row_count"} == {12.0}
    assert sessions(spark.read.parquet(str(src)), "ts", "k", "30 minutes").count() == 4


def test_command_line(spark, tmp_path, capsys):
    data = tmp_path / "t.csv"
    data.write_text("id,city\n" + "\n".join(f"{i},{'A' if i % 2 else 'B'}" for i in range(60)))
    args = ["analyze", str(data), "--as-of", "2024-01-01", "--history", str(tmp_path / "h"), "--out", str(tmp_path / "out")]
    assert cli.main([*args, "--tag", "one"]) == 0
    assert json.loads(capsys.readouterr().out)["objects"]["t"]["rows"] == 60
    data.write_text("id,city\n" + "\n".join(f"{i},A" for i in range(20)))
    assert cli.main([*args, "--tag", "two", "--fail-on", "fail", "--min-score", "health=1"]) == 2
    assert (tmp_path / "out" / "report.html").exists()
    capsys.readouterr()
    assert cli.main(["history", str(tmp_path / "h")]) == 0 and "two" in capsys.readouterr().out
    assert cli.main(["drift", str(tmp_path / "h"), "one", "two"]) == 2
    capsys.readouterr()
    assert cli.main(["schema", str(data)]) == 0 and "objects" in json.loads(capsys.readouterr().out)
    assert cli.main(["ask", str(data), "SELECT count(*) AS n FROM t"]) == 0 and json.loads(capsys.readouterr().out)["rows"] == [{"n": 20}]
    assert cli.main(["analyze", str(tmp_path / "missing.csv")]) == 3
    assert cli.main(["glossary"]) == 0 and cli.main(["version"]) == 0 and cli.main(["sources"]) == 0


def test_ask(spark):
    from vitalframe.plans import ask

    df = spark.range(7).select(F.struct(F.col("id")).alias("a"))
    p = ask.Scripted(['note {"action": "sql", "query": "SELECT max(`a.id`) AS m FROM t"}', '```json\n{"action": "sql", "query": "DROP TABLE t"}\n```', '{"action": "answer", "markdown": "six"}'])
    got = ask.ask("largest?", {"rows": 7}, {"t": df}, p, deadline_s=60)
    assert got["markdown"] == "six" and got["steps"][0]["result"]["rows"] == [{"m": 6}] and "error" in got["steps"][1]["result"]
    assert "a.id" in p.prompts[0] and "```sql" in ask.as_markdown("largest?", got)
    assert ask.ask("x", {}, {"t": df}, ask.Scripted(["just words"]))["markdown"] == "just words" and ask.first_json("{bad {\"a\": 1}") == {"a": 1}


def test_download(tmp_path):
    from vitalframe.sources import download

    src = tmp_path / "rows.csv"
    src.write_text("a,b\n1,2\n")
    at, kind = download.fetch(src.as_uri(), str(tmp_path / "cache"))
    assert kind == "csv" and open(at).read() == "a,b\n1,2\n" and download.clean(str(tmp_path / "cache")) == 0 and download.clean(str(tmp_path / "cache"), -1) == 1
    assert [download.detect(x) for x in ('{"a": 1}', '{"a": 1}\n{"a": 2}\n{"a": 3}', "<a><b/></a>", "a,b\n1,2", b"\xff\xfe", "plain")] == ["json", "jsonl", "xml", "csv", "unknown", "unknown"]
    assert download.validate("[1]", "json") and not download.validate("<a/>", "json")


def test_legacy_coverage_limits_and_rule_table(spark):
    a = spark.range(100).select(F.when(F.col("id") < 80, "x").alias("f"), F.lit("y").alias("g"))
    b = spark.range(100).select(F.when(F.col("id") < 60, "x").alias("f"), F.when(F.col("id") < 95, "y").alias("g"))
    d = compare.profile_diff(profiled({"o": a})[1], profiled({"o": b})[1])
    assert [(r["path"], r["scope"]) for r in drift.coverage_breaches(d, {}).collect()] == [("f", "default")]
    assert [(r["path"], r["scope"]) for r in drift.coverage_breaches(d, {"dataset": 50, "fields": {"o": {"g": 2}}}).collect()] == [("g", "field")]
    assert drift.coverage_breaches(d, {}, drops=False).collect() == []
    rules = drift.Rules({"objects": {"o": {"coverage": {"drop_pct": 5}}}})
    t = {(r["metric"], r["scope"]): r["fired"] for r in drift.rules_in_effect(rules, [{"kind": "coverage", "object": "o", "path": "f", "severity": "fail"}, {"kind": "field_removed", "object": "z", "path": "q", "severity": "fail"}])}
    assert t["coverage", "object"] == 1 and t["coverage", "builtin"] == 0 and t["schema", "builtin"] == 1


def test_seen_in_window_counts_earlier_runs(spark):
    rows = [(r, p) for r in range(1, 6) for p in (("a", "b") if r in (1, 4) else ("a",))]
    got = {(x["run"], x["path"]): (x["present"], x["seen"], x["runs"]) for x in drift.seen_in_window(spark.createDataFrame(rows, "run int, path string"), "run", ["path"], window=2).collect()}
    assert got[1, "a"] == (True, 0, 0) and got[5, "a"] == (True, 2, 2)
    assert got[2, "b"] == (False, 1, 1) and got[4, "b"] == (True, 0, 2) and got[5, "b"] == (False, 1, 2)
    assert drift.seen_in_window(spark.createDataFrame([], "run int, path string"), "run", ["path"]).count() == 0


def test_timeline_of_the_last_run(spark):
    rows = [(f"t{d:02}", datetime.date(2024, 1, d), "x", float(d)) for d in range(1, 11)] + [("t02", datetime.date(2024, 1, 2), "gone", 1.0), ("t10", datetime.date(2024, 1, 10), "new", 1.0)]
    rows += [("t09", datetime.date(2024, 1, 9), "late", 4.0), ("t10", datetime.date(2024, 1, 10), "late", 9.0)]
    schema = "tag string, day date, object string, value double"
    got = {r["object"]: r for r in drift.timeline(spark.createDataFrame(rows, schema), ["object"], points=3).collect()}
    assert set(got) == {"x", "late"}  # one has no present point, one no earlier point
    assert got["x"][1:] == ([8.0, 9.0, 10.0], 1.0, 9.0, 10.0, 1.0, 7.0, None)
    assert got["late"]["delta_1"] == 5.0 and got["late"]["delta_7"] is None  # the run of seven days ago lacks it
    assert drift.timeline(spark.createDataFrame([], schema), ["object"]).count() == 0


def test_relationships_and_statistics_of_nothing(spark):
    counts = analyze.counts_of({"t": spark.createDataFrame([], "parent_id string")})
    p = profile.fields(counts, analyze.row_counts({"t": spark.createDataFrame([], "parent_id string")}))
    assert profile.statistics_summary(p).where("object is not null").count() == 0
    assert relations.relationship_summary(relations.relationships(counts, p)).count() == 0


def test_streamed_bands_are_those_of_the_table(spark, tmp_path):
    from vitalframe.operators.drift import rolling_bands
    from vitalframe.streaming.windows import feed, learned_bands, windowed_profile

    src, out = tmp_path / "in", []
    kind = "ts timestamp, v string"
    for part in range(3):  # a file a batch; the last hours fall off
        rows = [(f"2024-01-01 {h:02d}:{m:02d}:{s:02d}", None if (m + h) % 3 == 0 else "x") for h in range(part * 8, part * 8 + 8) for m in range(0, 60, 5) for s in range(40 if h == 13 else 1 + h % 2)]
        spark.createDataFrame(rows, "t string, v string").select(F.to_timestamp("t").alias("ts"), "v").coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(kind).parquet(str(src))
        feed(learned_bands(windowed_profile(stream, "ts", ["v"]), window=5), lambda df, i: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(180)
    table = rolling_bands(windowed_profile(spark.read.schema(kind).parquet(str(src)), "ts", ["v"]), "window_start", ["metric", "path"], window=5)
    of = lambda rs: {(r["metric"], r["path"], r["window_start"]): (r["value"], r["severity"], r["lower"], r["upper"], r["n"]) for r in rs}
    got, want = of(out), of(table.collect())
    assert len(got) == len(out) >= 2 * 20 and got == {k: want[k] for k in got}
    assert {"cold", "ok", "fail"} <= {v[1] for v in got.values()}
