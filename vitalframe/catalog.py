"""Registered queries of the data-health operators, each with its SQL twin.

The driver tables hold no nulls and no orphans, so some queries derive them by
rule, the same way on both sides.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import privacy, scores
from .functions.patterns import PATTERNS
from .functions.values import infer_type, is_empty
from .operators import compare, drift, filters, keys, profile, quality, relations, runs, sampling, walk
from .plans import analyze
from .session import settle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
FLAT = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
#: Typed columns by the label their values get (strings are judged by value).
KINDS = {"string": "string", "bigint": "int", "int": "int", "double": "float", "timestamp": "date"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _profile(spark: SparkSession, d: str, names: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    tables = {n: table(spark, d, n) for n in names}
    counts = analyze.counts_of(tables)
    return counts, profile.fields(counts, analyze.row_counts(tables))


# ---------------------------------------------------------------- SQL building blocks

# Columns of the flat tables, for UNPIVOT-like unions in the twins.
COLUMNS = {
    "region": ("r_regionkey", "r_name"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
    "labels": ("doc_id", "quality", "toxic"),
    "conversations": ("conv_id", "turn", "role", "text"),
}


def _fields_sql(names: tuple[str, ...]) -> str:
    part = "SELECT '{t}' AS object, '{c}' AS path, count(*) AS presence, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS null_empty, count(DISTINCT {c}) AS distinct_values, count(*) AS n FROM {t}"
    rows = " UNION ALL ".join(part.format(t=t, c=c) for t in names for c in COLUMNS[t])
    return f"SELECT object, path, CAST(presence AS BIGINT) AS presence, CAST(null_empty AS BIGINT) AS null_empty, CAST(distinct_values AS BIGINT) AS distinct_values, 100.0 * (presence - null_empty) / n AS coverage, distinct_values <= 50 AS low_cardinality FROM ({rows})"


def _fields(spark: SparkSession, d: str, names: tuple[str, ...]) -> DataFrame:
    _, p = _profile(spark, d, names)
    return p.select("object", "path", F.col("presence").cast("long").alias("presence"), F.col("null_empty").cast("long").alias("null_empty"), F.col("distinct").cast("long").alias("distinct_values"), "coverage", "low_cardinality")


PROFILED = FLAT

# ---------------------------------------------------------------- profile


@query(_fields_sql(PROFILED))
def profile_fields_all(spark, d):
    return _fields(spark, d, PROFILED)


@query(_fields_sql(("lineitem",)))
def profile_fields_lineitem(spark, d):
    return _fields(spark, d, ("lineitem",))


@query("SELECT 'orders' AS object, 'o_orderstatus' AS path, 'string' AS type, count(*) AS n FROM orders UNION ALL SELECT 'orders', 'o_totalprice', 'float', count(*) FROM orders UNION ALL SELECT 'orders', 'o_orderkey', 'int', count(*) FROM orders UNION ALL SELECT 'orders', 'o_orderdate', 'date', count(*) FROM orders")
def type_histogram_orders(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderkey", "o_orderdate")
    return profile.type_histogram(profile.value_counts(walk.typed_nodes(o, "orders")))


@query("""WITH v AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN '' WHEN event_id % 7 = 2 THEN 'https://x.org/' || event_id WHEN event_id % 7 = 3 THEN 'u' || event_id || '@mail.org'
 WHEN event_id % 7 = 4 THEN '2024-01-02' WHEN event_id % 7 = 5 THEN lpad(CAST(event_id AS VARCHAR), 12, '1') ELSE event_type END AS s FROM events)
SELECT CASE WHEN s IS NULL THEN 'null' WHEN s = '' THEN 'string' WHEN s LIKE 'http%' THEN 'url' WHEN s LIKE '%@%' THEN 'email' WHEN s LIKE '2024-01-02' THEN 'date' WHEN regexp_matches(s, '^[0-9]{10,}$') THEN 'numeric_id' ELSE 'string' END AS type,
 (s IS NULL OR s = '') AS empty, count(*) AS n FROM v GROUP BY 1, 2""")
def infer_types_strings(spark, d):
    e, m = table(spark, d, "events"), F.col("event_id") % 7
    s = (
        F.when(m == 0, None).when(m == 1, "").when(m == 2, F.concat(F.lit("https://x.org/"), "event_id")).when(m == 3, F.concat(F.lit("u"), "event_id", F.lit("@mail.org")))
        .when(m == 4, "2024-01-02").when(m == 5, F.lpad(F.col("event_id").cast("string"), 12, "1")).otherwise(F.col("event_type"))
    )
    kind = e.schema["event_type"].dataType
    return e.select(s.alias("s")).groupBy(infer_type(F.col("s"), kind).alias("type"), is_empty(F.col("s"), kind).alias("empty")).agg(F.count("*").alias("n"))


@query("SELECT 'k' AS path, 'int' AS type, count(*) AS n, count(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS distinct_values FROM events")
def type_histogram_events_props(spark, d):
    v = table(spark, d, "events").select(F.parse_json("props").alias("v"))
    counts = profile.value_counts(walk.variant_nodes(v, "events"))
    return counts.groupBy("path", "type").agg(F.sum("n").alias("n"), F.count("value").alias("distinct_values"))


@query("SELECT 'embedding[]' AS path, CAST(count(*) FILTER (len(embedding) > 0) AS BIGINT) AS presence, CAST(sum(len(embedding)) AS BIGINT) AS elements FROM embeddings")
def array_presence_embeddings(spark, d):
    n = walk.typed_nodes(table(spark, d, "embeddings"), "embeddings").where("path = 'embedding[]'")
    return n.groupBy("path").agg(F.sum("present").cast("long").alias("presence"), F.count("*").alias("elements"))


_TOP = "SELECT '{c}' AS path, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {t} GROUP BY 2"


@query("WITH v AS (" + " UNION ALL ".join(_TOP.format(t=t, c=c) for t, c in (("orders", "o_orderstatus"), ("orders", "o_orderpriority"), ("customer", "c_mktsegment"), ("part", "p_type"), ("part", "p_brand"))) + ") SELECT path, value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, value) AS r FROM v) WHERE r <= 20")
def top_values(spark, d):
    t = {"orders": table(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), "customer": table(spark, d, "customer").select("c_mktsegment"), "part": table(spark, d, "part").select("p_type", "p_brand")}
    return profile.top_values(analyze.counts_of(t)).select("path", "value", "n", "rank")


@query("SELECT path, list_sort(list(value)) AS examples FROM (SELECT path, value, row_number() OVER (PARTITION BY path ORDER BY value) AS r FROM (SELECT DISTINCT 'n_name' AS path, n_name AS value FROM nation UNION SELECT DISTINCT 'r_name', r_name FROM region)) WHERE r <= 3 GROUP BY path")
def examples(spark, d):
    t = {"nation": table(spark, d, "nation").select("n_name"), "region": table(spark, d, "region").select("r_name")}
    return profile.examples(analyze.counts_of(t)).select("path", "examples")


_NUM = "SELECT '{c}' AS path, count(*) AS count, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.05) AS p5, quantile_cont({c}, 0.5) AS p50, quantile_cont({c}, 0.95) AS p95 FROM {t}"


@query("SELECT path, count, round(mean, 6) AS mean, round(std, 6) AS std, min, max, round(p5, 6) AS p5, round(p50, 6) AS p50, round(p95, 6) AS p95 FROM (" + " UNION ALL ".join(_NUM.format(t="lineitem", c=c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")) + ")")
def numeric_profile_lineitem(spark, d):
    x = table(spark, d, "lineitem")
    long = x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).alias("x")) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))).alias("r")).select("r.*")
    p = profile.numeric(long, ["path"], F.col("x"))
    r = lambda c: F.round(c, 6)
    return p.select("path", "count", r("mean").alias("mean"), r("std").alias("std"), "min", "max", r(F.col("quantiles")[1]).alias("p5"), r(F.col("quantiles")[10]).alias("p50"), r(F.col("quantiles")[19]).alias("p95"))


@query("""SELECT o_orderstatus, count(*) AS count, min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS stddev, round(quantile_cont(o_totalprice, 0.25), 4) AS p25,
 round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.75), 4) AS p75, round(quantile_cont(o_totalprice, 0.99), 4) AS p99, count(*) FILTER (o_totalprice = 0) AS zeros, count(*) FILTER (o_totalprice < 0) AS negatives,
 CASE WHEN count(*) < 10 THEN 'unknown' WHEN abs(avg(o_totalprice) - quantile_cont(o_totalprice, 0.5)) < 0.01 * abs(avg(o_totalprice)) THEN 'uniform' WHEN avg(o_totalprice) > quantile_cont(o_totalprice, 0.5) THEN 'skewed_right' ELSE 'skewed_left' END AS distribution
 FROM orders GROUP BY 1""")
def numeric_stats_orders(spark, d):
    s = profile.numeric_stats(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_totalprice"))
    r = lambda c: F.round(c, 4).alias(c)
    return s.select("o_orderstatus", "count", "min", "max", r("mean"), r("stddev"), r("p25"), r("p50"), r("p75"), r("p99"), "zeros", "negatives", "distribution")


@query("SELECT o_orderstatus, min(o_orderdate) AS first, max(o_orderdate) AS last, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS INTEGER) AS span_days, count(*) FILTER (o_orderdate > TIMESTAMP '1997-01-01') AS future, count(DISTINCT strftime(o_orderdate, '%Y-%m')) AS months FROM orders GROUP BY 1")
def temporal_profile_orders(spark, d):
    t = profile.temporal(table(spark, d, "orders"), ["o_orderstatus"], F.col("o_orderdate"), "1997-01-01")
    return t.select("o_orderstatus", "first", "last", "span_days", "future", F.size("months").cast("long").alias("months"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def temporal_histogram(spark, d):
    t = profile.temporal(table(spark, d, "orders"), [], F.col("o_orderdate"), "2000-01-01")
    return t.select(F.explode("months").alias("month", "n"))


@query("SELECT count(*) FILTER (i % 3 = 0) AS iso, count(*) FILTER (i % 3 = 1) AS slash, count(*) FILTER (i % 3 = 2) AS unread FROM (SELECT event_id AS i FROM events)")
def parse_dates(spark, d):
    from .functions.values import parse_date

    i = F.col("event_id") % 3
    s = F.when(i == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(i == 1, F.date_format("ts", "yyyy/MM/dd")).otherwise("no date")
    e = table(spark, d, "events").select(i.alias("i"), F.col("ts"), parse_date(s).alias("t"))
    return e.agg(
        F.count_if((F.col("i") == 0) & (F.col("t") == F.date_trunc("second", "ts"))).alias("iso"), F.count_if((F.col("i") == 1) & (F.to_date("t") == F.to_date("ts"))).alias("slash"), F.count_if((F.col("i") == 2) & F.col("t").isNull()).alias("unread")
    )


# DuckDB's expressions have no look-ahead: ipv6 is put in two conditions there.
def _pattern_sql() -> str:
    cases = []
    for name, rx in PATTERNS:
        cond = "regexp_matches(value, '^[0-9a-fA-F:]{3,}$') AND value LIKE '%:%:%'" if name == "ipv6" else f"regexp_matches(value, '{rx}')"
        cases.append(f"SELECT path, '{name}' AS pattern, avg(CASE WHEN {cond} THEN 1.0 ELSE 0.0 END) AS conformance FROM v GROUP BY path")
    v = "SELECT DISTINCT 'c_name' AS path, c_name AS value FROM customer UNION SELECT DISTINCT 'p_brand', p_brand FROM part UNION SELECT DISTINCT 'url', url FROM pages UNION SELECT DISTINCT 'r_name', r_name FROM region UNION SELECT DISTINCT 'lang', lang FROM documents"
    return f"WITH v AS ({v}), m AS ({' UNION ALL '.join(cases)}) SELECT path, pattern, conformance, row_number() OVER (PARTITION BY path ORDER BY conformance DESC, pattern) = 1 AS dominant FROM m WHERE conformance >= 0.6"


@query(_pattern_sql())
def pattern_conformance(spark, d):
    t = {"customer": table(spark, d, "customer").select("c_name"), "part": table(spark, d, "part").select("p_brand"), "pages": table(spark, d, "pages").select("url"), "region": table(spark, d, "region").select("r_name"), "documents": table(spark, d, "documents").select("lang")}
    shown = analyze.counts_of(t).where("value is not null").select("object", "path", "value")
    return quality.pattern_conformance(shown).select("path", "pattern", "conformance", "dominant")


_EMAILED = "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_name ELSE 'user' || c_custkey || '@example.com' END AS email, '+1 555-010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone FROM customer"


def _emailed(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k, F.when(k % 4 == 0, F.col("c_name")).otherwise(F.concat(F.lit("user"), k, F.lit("@example.com"))).alias("email"), F.concat(F.lit("+1 555-010-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"), "c_name"
    )


@query(f"SELECT avg(CASE WHEN regexp_matches(email, '{privacy.VALUE_SHAPES['email']}') THEN 1.0 ELSE 0.0 END) AS email_ratio, avg(CASE WHEN regexp_matches(phone, '{privacy.VALUE_SHAPES['phone']}') THEN 1.0 ELSE 0.0 END) AS phone_ratio FROM ({_EMAILED})")
def pii_value_ratio(spark, d):
    return _emailed(spark, d).agg(privacy.value_ratio(F.col("email"), "email").alias("email_ratio"), privacy.value_ratio(F.col("phone"), "phone").alias("phone_ratio"))


@query(f"SELECT c_custkey, CASE WHEN email LIKE '%@%' THEN left(email, 1) || '***@' || split_part(email, '@', 2) ELSE '***@***.***' END AS email, '***-***-' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) AS phone FROM ({_EMAILED})")
def mask_values(spark, d):
    e = _emailed(spark, d)
    return e.select("c_custkey", privacy.mask(F.col("email"), "email").alias("email"), privacy.mask(F.col("phone"), "phone").alias("phone"))


@query("SELECT s_suppkey, left(s_name, 1) || '***' AS name, left(s_name, 1) || repeat('*', length(s_name) - 2) || right(s_name, 1) AS other, '***-**-****' AS ssn FROM supplier")
def mask_names(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", privacy.mask(F.col("s_name"), "name").alias("name"), privacy.mask(F.col("s_name"), "address").alias("other"), privacy.mask(F.col("s_name"), "ssn").alias("ssn"))


@query(f"SELECT left(email, 1) || '***@' || split_part(email, '@', 2) AS value, count(*) AS n FROM ({_EMAILED}) WHERE email LIKE '%@%' GROUP BY 1")
def masked_value_counts(spark, d):
    e = _emailed(spark, d).where(F.col("email").contains("@"))
    return e.select(privacy.mask(F.col("email"), "email").alias("value")).groupBy("value").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- derived nulls: quality, co-null groups

_SPARSE = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 3 > 0 THEN '' ELSE 'x' END AS note, 'same' AS fixed FROM customer"


def _sparse(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k, F.when(k % 7 == 0, None).otherwise(F.col("c_name")).alias("c_name"), F.when(k % 7 == 0, None).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(k % 3 > 0, "").otherwise("x").alias("note"), F.lit("same").alias("fixed")
    )


def _sparse_profile(spark, d):
    t = {"customer": _sparse(spark, d)}
    counts = analyze.counts_of(t)
    return counts, profile.fields(counts, analyze.row_counts(t))


_SPARSE_FACTS = "SELECT '{c}' AS path, count(*) AS rows, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '') AS null_empty, count(DISTINCT {c}) AS d, count({c}) AS non_null FROM s"
_SPARSE_ALL = f"WITH s AS ({_SPARSE}), f AS (" + " UNION ALL ".join(_SPARSE_FACTS.format(c=c) for c in ("c_custkey", "c_name", "c_mktsegment", "note", "fixed")) + ")"


@query(_SPARSE_ALL + " SELECT null_empty, list_sort(list(path)) AS paths, count(*) AS fields FROM f WHERE rows >= 20 AND null_empty > 0 GROUP BY null_empty HAVING count(*) >= 2")
def co_null_groups(spark, d):
    return profile.co_null_groups(_sparse_profile(spark, d)[1]).select("null_empty", "paths", "fields")


_FIELD_Q = _SPARSE_ALL + ", q AS (SELECT path, 100.0 * (rows - null_empty) / rows AS completeness, 100.0 AS consistency, 100.0 - CASE WHEN path IN ('c_name', 'c_mktsegment', 'note', 'fixed') AND d = 1 AND non_null * 2 >= rows AND rows > 10 THEN 20 ELSE 0 END - CASE WHEN null_empty > 0.5 * rows THEN 30 ELSE 0 END AS validity, d, rows FROM f)"


@query(_FIELD_Q + " SELECT path, round(completeness, 6) AS completeness, consistency, validity, round(0.4 * completeness + 0.3 * consistency + 0.3 * validity, 6) AS score FROM q")
def field_quality(spark, d):
    q = quality.field_quality(_sparse_profile(spark, d)[1])
    return q.select("path", F.round("completeness", 6).alias("completeness"), "consistency", "validity", F.round("score", 6).alias("score"))


@query(_FIELD_Q + " SELECT round(avg(completeness), 6) AS completeness, round(avg(validity), 6) AS validity, 100.0 * count(*) FILTER (d > 1 AND d / rows < 0.99) / count(*) AS granularity FROM q")
def dqi_dimensions(spark, d):
    q = quality.object_quality(_sparse_profile(spark, d)[1], "2024-01-01")
    return q.select(F.round("completeness", 6).alias("completeness"), F.round("validity", 6).alias("validity"), "granularity")


@query("SELECT o_orderstatus, round(greatest(0.0, 100.0 - 25.0 * log10(greatest(1.0, date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2024-06-01') + 1.0))), 6) AS timeliness FROM orders GROUP BY 1")
def timeliness(spark, d):
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.max("o_orderdate").alias("m"))
    return o.select("o_orderstatus", F.round(quality.timeliness_score(F.datediff(F.lit("2024-06-01"), F.col("m"))), 6).alias("timeliness"))


@query(_SPARSE_ALL + " SELECT path, CASE WHEN d <= 50 THEN 'low' WHEN d > 0.3 * rows THEN 'high' ELSE 'medium' END AS cardinality FROM f")
def cardinality_labels(spark, d):
    return profile.cardinality_label(_sparse_profile(spark, d)[1]).select("path", "cardinality")


@query(_SPARSE_ALL + " SELECT path, 100.0 * (rows - null_empty) / rows AS coverage, CASE WHEN 100.0 * (rows - null_empty) / rows >= 90 THEN '90+' WHEN 100.0 * (rows - null_empty) / rows >= 75 THEN '75-90' WHEN 100.0 * (rows - null_empty) / rows >= 50 THEN '50-75' WHEN 100.0 * (rows - null_empty) / rows >= 25 THEN '25-50' ELSE '0-25' END AS band FROM f")
def coverage_heatmap(spark, d):
    return profile.heatmap(_sparse_profile(spark, d)[1]).select("path", "coverage", "band")


@query("SELECT 'doc_id' AS path, 2 AS n UNION ALL SELECT 'text', 3")
def common_fields(spark, d):
    _, p = _profile(spark, d, ("labels", "benchmark", "conversations", "documents"))
    return profile.common_fields(p).select("path", F.col("n").cast("int").alias("n"))


@query("SELECT value, n FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM events GROUP BY 1) ORDER BY n DESC, value LIMIT 10")
def content_universe(spark, d):
    t = {"part": table(spark, d, "part").select("p_type"), "events": table(spark, d, "events").select("event_type")}
    return profile.content_universe(analyze.counts_of(t), ("p_type", "event_type"))


@query("SELECT 'locale' AS dimension, lang AS value, count(*) AS n FROM documents GROUP BY lang")
def locale_dimensions(spark, d):
    return profile.locale_dimensions(profile.value_counts(walk.typed_nodes(table(spark, d, "documents").select("lang"), "documents")))


@query("SELECT 'x' AS path, 2 AS kinds")
def mixed_types(spark, d):
    v = table(spark, d, "orders").select(F.parse_json(F.when(F.col("o_orderkey") % 2 == 0, '{"x": 1, "y": "a"}').otherwise('{"x": "one", "y": "b"}')).alias("v"))
    counts = profile.value_counts(walk.variant_nodes(v, "orders"))
    rows = v.agg(F.lit("orders").alias("object"), F.count("*").alias("rows"))
    return profile.mixed_types(profile.fields(counts, rows)).select("path", F.col("kinds").cast("int").alias("kinds"))


# ---------------------------------------------------------------- relations

_FK = "SELECT '{n}' AS link, count(*) AS child_occurrences, count(*) FILTER (p.k IS NULL) AS orphan_occurrences, count(DISTINCT CASE WHEN p.k IS NULL THEN c.k END) AS orphan_distinct, 100.0 * count(*) FILTER (p.k IS NULL) / count(*) AS orphan_pct FROM (SELECT {ck} AS k FROM {c}) c LEFT JOIN (SELECT DISTINCT {pk} AS k FROM {p}) p ON c.k = p.k"
LINKS = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("labels", "doc_id", "documents", "doc_id"), ("events", "user_id", "customer", "c_custkey"))


@query(" UNION ALL ".join(_FK.format(n=f"{c}.{ck}", c=c, ck=ck, p=p, pk=pk) for c, ck, p, pk in LINKS))
def fk_integrity_clean(spark, d):
    out = None
    for c, ck, p, pk in LINKS:
        one = relations.integrity(table(spark, d, c), ck, table(spark, d, p), pk).withColumn("link", F.lit(f"{c}.{ck}"))
        out = one if out is None else out.unionByName(one)
    return out.select("link", "child_occurrences", "orphan_occurrences", "orphan_distinct", "orphan_pct")


@query(_FK.format(n="lineitem.l_orderkey", c="lineitem", ck="l_orderkey", p="(SELECT * FROM orders WHERE o_orderkey % 50 <> 0)", pk="o_orderkey"))
def fk_integrity_orphans(spark, d):
    parent = table(spark, d, "orders").where("o_orderkey % 50 <> 0")
    return relations.integrity(table(spark, d, "lineitem"), "l_orderkey", parent, "o_orderkey").select(F.lit("lineitem.l_orderkey").alias("link"), "child_occurrences", "orphan_occurrences", "orphan_distinct", "orphan_pct")


@query("""WITH t AS (SELECT c.n_nationkey AS k FROM nation c), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1)
SELECT 'supplier' AS child, 's_nationkey' AS child_path, 'nation' AS parent, 'n_nationkey' AS parent_path, CAST(sum(s.n) AS BIGINT) AS child_occurrences, CAST(coalesce(sum(s.n) FILTER (t.k IS NULL), 0) AS BIGINT) AS orphan_occurrences FROM s LEFT JOIN t ON s.k = t.k""")
def references_supplier(spark, d):
    t = {"supplier": table(spark, d, "supplier").select("s_nationkey", "s_name"), "nation": table(spark, d, "nation").select("n_nationkey", "n_name")}
    counts = analyze.counts_of(t)
    r = relations.references(counts, settle(profile.fields(counts, analyze.row_counts(t))))
    return r.where("rank = 1").select("child", "child_path", "parent", "parent_path", "child_occurrences", "orphan_occurrences")


@query("""WITH a AS (SELECT o_custkey AS v, count(*) AS na FROM orders GROUP BY 1), b AS (SELECT user_id AS v, count(*) AS nb FROM events GROUP BY 1), m AS (SELECT * FROM a FULL JOIN b USING (v))
SELECT count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) AS shared, count(na) AS a_distinct, count(nb) AS b_distinct, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) / count(*) AS jaccard, count(*) FILTER (na IS NOT NULL AND nb IS NOT NULL) / count(na) AS overlap, coalesce(sum(na) FILTER (nb IS NOT NULL), 0) / sum(na) AS contained FROM m""")
def value_overlap(spark, d):
    return compare.value_overlap(table(spark, d, "orders"), "o_custkey", table(spark, d, "events"), "user_id")


_PAIR = "WITH a AS (SELECT {ac} AS v, count(*) AS n FROM {a} GROUP BY 1), b AS (SELECT {bc} AS v, count(*) AS n FROM {b} GROUP BY 1), m AS (SELECT a.v AS av, b.v AS bv, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.v = b.v), s AS (SELECT count(*) FILTER (av IS NOT NULL AND bv IS NOT NULL) / count(*) AS jaccard, greatest(sum(an) FILTER (bv IS NOT NULL) / sum(an), sum(bn) FILTER (av IS NOT NULL) / sum(bn)) AS contained FROM m)"


@query(_PAIR.format(a="customer", ac="c_custkey", b="orders", bc="o_custkey") + " SELECT 'customer' AS a_object, 'c_custkey' AS a_path, 'orders' AS b_object, 'o_custkey' AS b_path, round(jaccard, 9) AS jaccard, round(contained, 9) AS contained, round(least(1.0, 0.7 * greatest(jaccard, contained) + 0.3 + 0.12), 9) AS confidence FROM s")
def value_overlap_pairs(spark, d):
    t = {"customer": table(spark, d, "customer").select("c_custkey"), "orders": table(spark, d, "orders").select("o_custkey")}
    counts = analyze.counts_of(t)
    j = relations.joins(counts, settle(profile.fields(counts, analyze.row_counts(t))))
    return j.select("a_object", "a_path", "b_object", "b_path", *(F.round(c, 9).alias(c) for c in ("jaccard", "contained", "confidence")))


@query("WITH a AS (SELECT DISTINCT o_orderstatus AS v FROM orders), b AS (SELECT DISTINCT l_linestatus AS v FROM lineitem UNION SELECT 'P') SELECT 'events' AS a_object, 'orders' AS b_object, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS shared, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) / count(*) AS jaccard FROM a FULL JOIN b ON a.v = b.v")
def shared_enums(spark, d):
    b = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("lstat")).union(spark.range(1).select(F.lit("P")))
    t = {"orders": table(spark, d, "orders").select(F.col("o_orderstatus").alias("ostat")), "events": b}
    counts = analyze.counts_of(t)
    return relations.shared_enums(counts, settle(profile.fields(counts, analyze.row_counts(t))), 0.1).select("a_object", "b_object", "shared", "jaccard")


_DUP = "SELECT o_custkey, CASE WHEN o_orderkey % 40 = 0 THEN o_custkey + 1 ELSE o_custkey END AS cust_copy, (o_custkey * 7) % 1000 AS other_key FROM orders"


@query(f"SELECT 'o_custkey' AS field_a, 'cust_copy' AS field_b, count(*) AS both_filled, count(*) FILTER (o_custkey = cust_copy) AS equal, count(*) FILTER (o_custkey = cust_copy) / count(*) AS row_equality FROM ({_DUP}) UNION ALL SELECT 'o_custkey', 'other_key', count(*), count(*) FILTER (o_custkey = other_key), count(*) FILTER (o_custkey = other_key) / count(*) FROM ({_DUP})")
def duplicate_fields(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 40 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("cust_copy"), ((F.col("o_custkey") * 7) % 1000).alias("other_key"))
    return relations.row_equality(o, [("o_custkey", "cust_copy"), ("o_custkey", "other_key")]).select("field_a", "field_b", F.col("both").alias("both_filled"), "equal", "row_equality")


@query("WITH a AS (SELECT DISTINCT s_nationkey AS v FROM supplier), b AS (SELECT DISTINCT (s_nationkey + 1) % 25 AS v FROM supplier) SELECT * FROM (SELECT 's_nationkey' AS field_a, 't_nationkey' AS field_b, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) / count(*) AS jaccard FROM a FULL JOIN b ON a.v = b.v) WHERE jaccard >= 0.6")
def shared_domains(spark, d):
    t = {"supplier": table(spark, d, "supplier").select("s_nationkey", ((F.col("s_nationkey") + 1) % 25).alias("t_nationkey"))}
    counts = analyze.counts_of(t)
    return relations.same_values(counts, settle(profile.fields(counts, analyze.row_counts(t)))).select("field_a", "field_b", "jaccard")


_UNIQ = "SELECT '{n}' AS name, CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_keys, count(*) FILTER (n > 1) AS repeated, sum(n) = count(*) AS is_unique FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})"
KEYS = (("lineitem", ("l_orderkey", "l_linenumber")), ("conversations", ("conv_id", "turn")), ("orders", ("o_orderkey",)), ("orders", ("o_custkey",)))


@query(" UNION ALL ".join(_UNIQ.format(n=f"{t}:{','.join(k)}", t=t, k=", ".join(k)) for t, k in KEYS))
def key_uniqueness(spark, d):
    out = None
    for t, k in KEYS:
        one = relations.uniqueness(table(spark, d, t), k).select(F.lit(f"{t}:{','.join(k)}").alias("name"), "rows", F.col("distinct").alias("distinct_keys"), "repeated", F.col("unique").alias("is_unique"))
        out = one if out is None else out.union(one)
    return out


# Orders by the parts of their key in mixed radix: it takes all four to tell them apart.
_RADIX = (("ka", 1, 7), ("kb", 7, 11), ("kc", 77, 13), ("kd", 1001, None))
_PLANTED = "SELECT {parts}, o_orderstatus FROM orders".format(parts=", ".join(f"{f'(o_orderkey // {by}) % {of}' if of else f'o_orderkey // {by}'} AS {n}" for n, by, of in _RADIX))
KEY_FIELDS = {
    "conversations": ("role", "turn", "conv_id"),
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity"),
    "planted": ("o_orderstatus", "ka", "kb", "kc", "kd"),
}


def _all_sets(name: str, source: str, fields: tuple[str, ...]) -> str:
    """Counts of every set of fields, in the order in which sets are preferred."""
    sets = [s for k in range(1, len(fields) + 1) for s in itertools.combinations(fields, k)]
    one = "SELECT '{name}' AS object, {i} AS place, '{key}' AS key_fields, (SELECT count(*) FROM {source}) AS rows, (SELECT count(*) FROM (SELECT DISTINCT {cols} FROM {source})) AS distinct_keys"
    return " UNION ALL ".join(one.format(name=name, i=i, key=",".join(s), cols=", ".join(s), source=source) for i, s in enumerate(sets))


@query("WITH c AS (" + " UNION ALL ".join(_all_sets(t, f"({_PLANTED})" if t == "planted" else t, f) for t, f in KEY_FIELDS.items()) + ") SELECT object, arg_min(key_fields, place) AS key_fields, arg_min(distinct_keys, place) AS distinct_keys, any_value(rows) AS rows FROM c WHERE distinct_keys >= 0.95 * rows GROUP BY object")
def composite_key_check(spark, d):
    planted = table(spark, d, "orders").selectExpr(*(f"o_orderkey div {by}{f' % {of}' if of else ''} AS {n}" for n, by, of in _RADIX), "o_orderstatus")
    out = spark.createDataFrame([], "object string, key_fields string, distinct_keys bigint, rows bigint")
    for name, fields in KEY_FIELDS.items():
        df = planted if name == "planted" else table(spark, d, name)
        found = keys.find_key(df, fields, 0.95)
        if found:
            out = out.union(relations.uniqueness(df, found).select(F.lit(name).alias("object"), F.lit(",".join(found)).alias("key_fields"), F.col("distinct").alias("distinct_keys"), "rows"))
    return out


# ---------------------------------------------------------------- sampling, filters, SQL


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def reservoir_sample_orders(spark, d):
    return sampling.reservoir(table(spark, d, "orders"), 100, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def tail_orders(spark, d):
    return sampling.tail(table(spark, d, "orders"), 25, ["o_orderkey"]).select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 1000 AND o_orderpriority <> '1-URGENT' AND o_custkey IS NOT NULL AND o_orderkey NOT IN (1, 2, 3)")
def document_filters(spark, d):
    o = table(spark, d, "orders")
    q = {"o_orderstatus": {"$in": ["F", "O"]}, "o_totalprice": {"$gte": 1000}, "o_orderpriority": {"$ne": "1-URGENT"}, "o_custkey": {"$exists": True}, "o_orderkey": {"$nin": [1, 2, 3]}}
    return o.where(filters.predicate(q, o.schema)).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY 1 LIMIT 201")
def sql_sandbox_group(spark, d):
    got = filters.run_query({"t_orders": table(spark, d, "orders")}, "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM t_orders GROUP BY 1 ORDER BY 1", deadline_s=120)
    return spark.createDataFrame([(r["o_orderstatus"], r["n"], r["top"]) for r in got["rows"]], "o_orderstatus string, n long, top double")


@query("SELECT vec_id, to_json(embedding) IS NOT NULL AS has_json, len(embedding) AS n FROM embeddings")
def flatten_arrays(spark, d):
    e = table(spark, d, "embeddings")
    return filters.flatten(e).select("vec_id", F.col("embedding").isNotNull().alias("has_json"), F.size(F.from_json("embedding", "array<double>")).cast("long").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d FROM orders")
def normalised_values(spark, d):
    from .functions.values import normalised

    o = table(spark, d, "orders")
    return o.select("o_orderkey", normalised(F.col("o_orderdate"), o.schema["o_orderdate"].dataType)[0].alias("d"))


# ---------------------------------------------------------------- drift and comparison

_CHANGES = """WITH o AS (SELECT event_type AS value, count(*) AS n FROM events WHERE event_id % 5 <> 0 GROUP BY 1), c AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'other' ELSE event_type END AS value, count(*) AS n FROM events WHERE event_id % 5 = 0 AND event_type <> 'click' GROUP BY 1),
m AS (SELECT coalesce(o.value, c.value) AS value, coalesce(o.n, 0) AS old_n, coalesce(c.n, 0) AS new_n FROM o FULL JOIN c ON o.value = c.value), s AS (SELECT *, old_n / sum(old_n) OVER () AS old_share, new_n / sum(new_n) OVER () AS new_share FROM m)"""


def _changes(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_id % 5 <> 0").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n"))
    new = e.where("event_id % 5 = 0 and event_type <> 'click'").groupBy(F.when(F.col("event_id") % 11 == 0, "other").otherwise(F.col("event_type")).alias("value")).agg(F.count("*").alias("n"))
    key = lambda x: x.withColumns({"object": F.lit("events"), "path": F.lit("event_type")})
    return drift.category_changes(key(old), key(new))


@query(_CHANGES + " SELECT value, CAST(old_n AS BIGINT) AS old_n, CAST(new_n AS BIGINT) AS new_n, new_share - old_share AS shift, CASE WHEN old_n = 0 THEN 'new' WHEN new_n = 0 THEN 'vanished' ELSE 'kept' END AS status FROM s")
def category_changes(spark, d):
    return _changes(spark, d).select("value", "old_n", "new_n", "shift", "status")


@query(_CHANGES + " SELECT round(sum((greatest(new_share, 1e-4) - greatest(old_share, 1e-4)) * ln(greatest(new_share, 1e-4) / greatest(old_share, 1e-4))), 9) AS psi, (count(*) - 1) * (1.0 / sum(old_n) + 1.0 / sum(new_n)) AS noise, count(*) FILTER (old_n = 0) AS new_values, count(*) FILTER (new_n = 0) AS vanished_values FROM s")
def psi_categorical_event_type(spark, d):
    return drift.categorical_psi(_changes(spark, d)).select(F.round("psi", 9).alias("psi"), "noise", "new_values", "vanished_values")


@query(_CHANGES + " SELECT value, CAST(r AS INTEGER) AS rank FROM (SELECT value, row_number() OVER (ORDER BY abs(new_share - old_share) DESC, value) AS r FROM s) WHERE r <= 3")
def share_movers(spark, d):
    return drift.share_movers(_changes(spark, d)).select("value", "rank")


_BINS = "+".join(f"(value > e[{i}])::INT" for i in range(2, 12))


@query(f"""WITH e AS (SELECT quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM events WHERE event_id % 5 <> 0),
b AS (SELECT CASE WHEN value < e[1] THEN 0 ELSE 1 + {_BINS} END AS b, count(*) FILTER (event_id % 5 <> 0) AS o, count(*) FILTER (event_id % 5 = 0) AS n FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN value * 1.3 ELSE value END AS value FROM events), e GROUP BY 1),
s AS (SELECT greatest(o / sum(o) OVER (), 1e-4) AS o, greatest(n / sum(n) OVER (), 1e-4) AS n FROM b) SELECT round(sum((n - o) * ln(n / o)), 6) AS psi FROM s""")
def psi_numeric_value(spark, d):
    e = table(spark, d, "events")
    return drift.numeric_psi(e.where("event_id % 5 <> 0"), e.where("event_id % 5 = 0").withColumn("value", F.col("value") * 1.3), "value").select(F.round("psi", 6).alias("psi"))


_HOURLY = "SELECT date_trunc('hour', ts) AS hour, count(*)::DOUBLE AS value FROM events GROUP BY 1"
_BAND = f"""WITH h AS ({_HOURLY}), w AS (SELECT hour, value, list(value) OVER (ORDER BY hour ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS seen FROM h),
m AS (SELECT *, list_median(seen) AS median, list_median(list_transform(seen, lambda x: abs(x - list_median(seen)))) AS mad FROM w),
s AS (SELECT *, CASE WHEN greatest(1.4826 * mad, 0.0, 0.05 * abs(median)) = 0 THEN 1e-9 ELSE greatest(1.4826 * mad, 0.0, 0.05 * abs(median)) END AS sigma FROM m),
b AS (SELECT *, least(median - 3 * sigma, list_min(seen) - 0.05 * abs(list_min(seen))) AS lower, greatest(median + 3 * sigma, list_max(seen) + 0.05 * abs(list_max(seen))) AS upper FROM s)
SELECT hour, value, median, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN len(seen) < 3 OR seen IS NULL THEN 'cold' WHEN value BETWEEN lower AND upper THEN 'ok' WHEN abs((value - median) / sigma) > 3 THEN 'fail' ELSE 'warn' END AS severity FROM b""".replace("list_median(", "list_aggregate(").replace("list_aggregate(seen)", "list_aggregate(seen, 'median')").replace("lambda x: abs(x - list_aggregate(seen, 'median'))))", "lambda x: abs(x - list_aggregate(seen, 'median'))), 'median')")


@query(_BAND)
def rolling_band_event_counts(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").cast("double").alias("value")).withColumn("series", F.lit("events"))
    b = drift.rolling_bands(h, "hour", ["series"])
    return b.select("hour", "value", "median", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "severity")


@query(f"WITH h AS (SELECT strftime(hour, '%Y%m%d%H') AS tag, CAST(hour AS DATE) AS day FROM ({_HOURLY}) WHERE hour(hour) = 0), k AS (SELECT unnest([1, 7, 30]) AS days) SELECT c.tag, CAST(k.days AS INTEGER) AS days, (SELECT max(o.tag) FROM h o WHERE o.day <= c.day - CAST(k.days AS INTEGER)) AS ref_tag FROM h c, k")
def asof_run_delta(spark, d):
    h = table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).where(F.hour("hour") == 0)
    runs = h.select(F.date_format("hour", "yyyyMMddHH").alias("tag"), F.to_date("hour").alias("day"))
    return drift.as_of(runs)


# Runs made of days: what came of each event type, who sent it, and how many values are above 20. Of
# the 30th, two thirds of some types are missing; every sixth day counts as a breach.
_LOST = "NOT (day(ts) = 30 AND event_id % 3 <> 0 AND event_type < 'm')"
_DAYS = f"""WITH d AS (SELECT strftime(ts, '%Y%m%d') AS tag, event_type AS object, count(*)::DOUBLE AS n, count(DISTINCT user_id)::DOUBLE AS users, 100.0 * count(*) FILTER (value > 20) / count(*) AS filled FROM events WHERE {_LOST} GROUP BY 1, 2),
v AS (SELECT tag, object, n, unnest(['row_count', 'coverage', 'distinct']) AS metric, unnest(['', 'value', 'user_id']) AS path, unnest([n, filled, users]) AS value FROM d)"""
_SE = "100 * sqrt(greatest(({p}) / 100 * (1 - ({p}) / 100), 1 / (4 * {n} * {n})) / {n})"
_MOVED = f"""j AS (SELECT c.metric, c.object, c.path, c.n AS n_new, r.n AS n_old, r.value AS old, c.value AS new, abs(c.value - r.value) AS gap, CASE WHEN r.value <> 0 THEN abs(c.value - r.value) / abs(r.value) * 100 ELSE 100 END AS pct FROM v c JOIN v r USING (metric, object, path) WHERE c.tag = {{now}} AND r.tag = {{then}}),
t AS (SELECT metric AS kind, object, path, old, new, CASE WHEN new < old THEN 'drop' WHEN new > old THEN 'increase' ELSE 'unchanged' END AS direction, CASE
 WHEN metric = 'row_count' AND new < old THEN CASE WHEN pct >= 25 THEN 'fail' WHEN pct >= 10 THEN 'warn' ELSE 'ok' END
 WHEN metric = 'row_count' AND new > old THEN CASE WHEN pct >= 200 THEN 'fail' WHEN pct >= 50 THEN 'warn' ELSE 'ok' END
 WHEN least(n_old, n_new) < 20 THEN 'ok'
 WHEN metric = 'coverage' THEN CASE WHEN gap <= 3 * sqrt(power({_SE.format(p="(old + new) / 2", n="n_old")}, 2) + power({_SE.format(p="(old + new) / 2", n="n_new")}, 2)) OR gap < 1 OR pct < CASE WHEN new < old THEN 25 ELSE 50 END THEN 'ok' ELSE 'fail' END
 WHEN metric = 'distinct' AND gap >= 3 AND pct >= 25 THEN 'warn' ELSE 'ok' END AS severity FROM j)"""
_FIRST, _LAST, _BEFORE = "(SELECT min(tag) FROM v)", "(SELECT max(tag) FROM v)", "(SELECT max(tag) FROM v WHERE tag < (SELECT max(tag) FROM v))"
_TOLD = "kind, object, path, severity, round(old, 6) AS old, round(new, 6) AS new, direction"


def _days(spark, d):
    e = table(spark, d, "events").where("not (day(ts) = 30 and event_id % 3 <> 0 and event_type < 'm')")
    day = e.groupBy(F.date_format("ts", "yyyyMMdd").alias("tag"), F.to_date("ts").alias("run_date"), F.col("event_type").alias("object")).agg(
        F.count("*").cast("double").alias("n"), F.countDistinct("user_id").cast("double").alias("users"), (100.0 * F.count_if(F.col("value") > 20) / F.count("*")).alias("filled")
    )
    each = F.array(*(F.struct(F.lit(m).alias("metric"), F.lit(p).alias("path"), F.col(c).alias("value")) for m, p, c in (("row_count", "", "n"), ("sampled", "", "n"), ("coverage", "value", "filled"), ("distinct", "user_id", "users"))))
    return day.select("tag", "run_date", "object", F.explode(each).alias("m")).select("tag", "run_date", "m.metric", "object", "m.path", "m.value", (F.dayofmonth("run_date") % 6 == 0).alias("breached"))


def _day_findings(spark, d, mode):
    """The last day against the day before, the first day, or bands of all days before."""
    v = _days(spark, d)
    tags = sorted(r["tag"] for r in v.select("tag").distinct().collect())  # a row per day
    of = lambda t: v.where(F.col("tag") == t).select("metric", "object", "path", "value")
    reference = runs.Stored(of(tags[0] if mode.startswith("baseline") else tags[-2]), None, None)
    past = runs.Past(reference, mode=mode, metrics=v.where(F.col("tag") < tags[-1]), recent=tags[-2::-1])
    return runs.metric_findings(of(tags[-1]), past).withColumns({c: F.round(c, 6) for c in ("old", "new", "lower", "upper")})


@query(f"{_DAYS}, {_MOVED.format(now=_LAST, then=_BEFORE)} SELECT {_TOLD} FROM t WHERE severity <> 'ok'")
def drift_previous(spark, d):
    return _day_findings(spark, d, "previous").select("kind", "object", "path", "severity", "old", "new", "direction")


@query(f"{_DAYS}, {_MOVED.format(now=_LAST, then=_FIRST)} SELECT {_TOLD} FROM t WHERE severity <> 'ok'")
def drift_baseline(spark, d):
    return _day_findings(spark, d, "baseline:first").select("kind", "object", "path", "severity", "old", "new", "direction")


_MEDIAN = "list_aggregate({x}, 'median')"
_ROLLED = f"""p AS (SELECT metric, object, path, value, row_number() OVER (PARTITION BY metric, object, path ORDER BY tag DESC) AS back FROM v WHERE tag < {_LAST} AND CAST(tag AS INTEGER) % 100 % 6 <> 0),
s AS (SELECT metric, object, path, list(value) AS seen FROM p WHERE back <= 14 GROUP BY ALL),
c AS (SELECT v.*, coalesce(seen, []) AS seen FROM v LEFT JOIN s USING (metric, object, path) WHERE tag = {_LAST}),
m AS (SELECT *, {_MEDIAN.format(x="seen")} AS median, list_sort(seen)[len(seen) // 2 + 1] AS middle FROM c),
a AS (SELECT *, {_MEDIAN.format(x="list_transform(seen, lambda x: abs(x - median))")} AS mad, CASE metric WHEN 'coverage' THEN {_SE.format(p="middle", n="n")} ELSE 1.0 END AS floor FROM m),
g AS (SELECT *, greatest(1.4826 * mad, floor, 0.05 * abs(median)) AS sigma FROM a),
b AS (SELECT *, greatest(0, least(median - 3 * sigma, list_min(seen) - 0.05 * abs(list_min(seen)))) AS lower, least(CASE metric WHEN 'coverage' THEN 100 ELSE 1e18 END, greatest(median + 3 * sigma, list_max(seen) + 0.05 * abs(list_max(seen)))) AS upper FROM g)"""


@query(f"""{_DAYS}, {_MOVED.format(now=_LAST, then=_BEFORE)}, {_ROLLED}
SELECT metric AS kind, object, path, CASE WHEN abs(value - median) / sigma > 3 THEN 'fail' ELSE 'warn' END AS severity, round(median, 6) AS old, round(value, 6) AS new, CASE WHEN value < median THEN 'drop' ELSE 'increase' END AS direction, round(lower, 6) AS lower, round(upper, 6) AS upper, 'rolling' AS scope FROM b WHERE len(seen) >= 3 AND NOT value BETWEEN lower AND upper
UNION ALL SELECT {_TOLD}, NULL, NULL, 'builtin' FROM t JOIN b ON b.metric = t.kind AND b.object = t.object AND b.path = t.path WHERE len(seen) < 3 AND severity <> 'ok'""".replace(f"SELECT {_TOLD}, NULL", "SELECT t.kind, t.object, t.path, t.severity, round(t.old, 6), round(t.new, 6), t.direction, NULL"))
def drift_rolling(spark, d):
    return _day_findings(spark, d, "rolling").select("kind", "object", "path", "severity", "old", "new", "direction", "lower", "upper", "scope")


@query(f"{_DAYS}, {_ROLLED} SELECT metric, object, path, CAST(len(seen) AS INTEGER) AS n, round(value, 6) AS value, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN len(seen) < 3 THEN 'cold' WHEN value BETWEEN lower AND upper THEN 'ok' WHEN abs(value - median) / sigma > 3 THEN 'fail' ELSE 'warn' END AS severity FROM b")
def rolling_scores(spark, d):
    """Every series of the last day with its learned band, in order or not."""
    v = _days(spark, d)
    last = v.agg(F.max("tag")).first()[0]
    got = runs.scored_by_bands(v.where(F.col("tag") == last).select("metric", "object", "path", "value"), v.where(F.col("tag") < last), drift.Rules())
    return got.select("metric", "object", "path", F.col("n").cast("int").alias("n"), *(F.round(c, 6).alias(c) for c in ("value", "lower", "upper")), "severity")


@query(f"{_DAYS}, {_MOVED.format(now=_LAST, then=_BEFORE)} SELECT kind AS metric, object, path, old, new, new - old AS delta, severity FROM t")
def threshold_findings(spark, d):
    """All metrics of the last day against the day before, also those that are in order."""
    v = _days(spark, d)
    tags = sorted(r["tag"] for r in v.select("tag").distinct().collect())[-2:]  # a row per day
    side = lambda t: v.where(F.col("tag") == t).select("metric", "object", "path", "value")
    return drift.threshold_findings(side(tags[1]), side(tags[0])).drop("direction", "threshold", "scope")


_CDF = "CASE WHEN len(list_filter({q}, lambda v: v {op} x)) = 0 THEN 0 WHEN len(list_filter({q}, lambda v: v {op} x)) = 21 THEN 1 ELSE (len(list_filter({q}, lambda v: v {op} x)) - 1) * 0.05 + 0.05 * (x - {q}[len(list_filter({q}, lambda v: v {op} x))]) / ({q}[len(list_filter({q}, lambda v: v {op} x)) + 1] - {q}[len(list_filter({q}, lambda v: v {op} x))]) END"
_BOTH = ", ".join(f"CASE WHEN i = 1 THEN {_CDF.format(q=q, op='<')} ELSE {_CDF.format(q=q, op='<=')} END AS {q}c" for q in ("o", "n"))
_LEVELS = str([i / 20 for i in range(21)])


@query(f"""WITH q AS (SELECT event_type, quantile_cont(value, {_LEVELS}) FILTER (event_id % 5 <> 0) AS o, quantile_cont(value * 1.3, {_LEVELS}) FILTER (event_id % 5 = 0) AS n FROM events GROUP BY 1),
e AS (SELECT *, list_sort(list_distinct(list_transform(range(1, 22, 2), lambda i: o[i]))) AS e FROM q),
x AS (SELECT event_type, o, n, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM e),
c AS (SELECT event_type, i, {_BOTH} FROM x UNION ALL SELECT event_type, len(e) + 1, 1, 1 FROM e),
s AS (SELECT event_type, greatest(greatest(oc - lag(oc, 1, 0) OVER w, 0), 1e-4) AS a, greatest(greatest(nc - lag(nc, 1, 0) OVER w, 0), 1e-4) AS b FROM c WINDOW w AS (PARTITION BY event_type ORDER BY i))
SELECT event_type, round(sum((b - a) * ln(b / a)), 3) AS psi FROM s GROUP BY 1""")
def quantile_psi(spark, d):
    """Numeric drift from the 21 quantiles that a run keeps of each number."""
    e = table(spark, d, "events")
    of = lambda df, x, name: profile.numeric(df, ["event_type"], x).select("event_type", F.col("quantiles").alias(name))
    met = of(e.where("event_id % 5 <> 0"), F.col("value"), "o").join(of(e.where("event_id % 5 = 0"), F.col("value") * 1.3, "n"), "event_type")
    return met.select("event_type", F.round(runs.quantile_psi(F.col("o"), F.col("n")), 3).alias("psi"))


_OLD = "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 10 <> 0"
_NEW = "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'X' WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 9 <> 0"


def _two(spark, d):
    o, k = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderkey")
    new = o.where("o_orderkey % 9 <> 0").withColumn("o_orderstatus", F.when(k % 11 == 0, "X").when(k % 13 == 0, None).otherwise(F.col("o_orderstatus")))
    return o.where("o_orderkey % 10 <> 0"), new


@query(f"""WITH a AS ({_OLD}), b AS ({_NEW}), m AS (SELECT a.o_orderkey AS ka, b.o_orderkey AS kb, a.o_orderstatus AS x, b.o_orderstatus AS y FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN kb IS NULL THEN 'only_in_1' WHEN ka IS NULL THEN 'only_in_2' WHEN y IS NULL THEN 'value_to_null' WHEN x IS DISTINCT FROM y THEN 'modified' END AS kind FROM m) WHERE kind IS NOT NULL GROUP BY 1""")
def record_diff_orders(spark, d):
    a, b = _two(spark, d)
    return compare.record_changes(a, b, ["o_orderkey"]).groupBy("kind").agg(F.count("*").alias("n"))


_PARTS_OLD = "SELECT l_orderkey % 50 || '|' AS a, l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_orderkey AS b, l_quantity AS q FROM lineitem WHERE l_orderkey % 10 <> 0"
_PARTS_NEW = "SELECT CASE WHEN l_orderkey % 50 <> 7 THEN l_orderkey % 50 || '|' END AS a, l_partkey || '|' || l_suppkey || '|' || l_linenumber || '|' || l_orderkey AS b, l_quantity + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS q FROM lineitem WHERE l_orderkey % 9 <> 0"


@query(f"""WITH o AS (SELECT a, b, max(q) AS q FROM ({_PARTS_OLD}) GROUP BY ALL), w AS (SELECT a, b, max(q) AS q FROM ({_PARTS_NEW}) GROUP BY ALL)
SELECT kind, count(*) AS n FROM (SELECT CASE WHEN w.b IS NULL THEN 'only_in_1' WHEN o.b IS NULL THEN 'only_in_2' WHEN o.q <> w.q THEN 'modified' END AS kind FROM o FULL JOIN w ON o.b = w.b AND o.a IS NOT DISTINCT FROM w.a) WHERE kind IS NOT NULL GROUP BY 1""")
def record_diff_composite(spark, d):
    """Keys of two parts, which hold separators and may be null."""
    li, k = table(spark, d, "lineitem"), F.col("l_orderkey")
    a, b = F.concat((k % 50).cast("string"), F.lit("|")), F.concat_ws("|", "l_partkey", "l_suppkey", "l_linenumber", "l_orderkey").alias("b")
    old = li.where("l_orderkey % 10 <> 0").select(a.alias("a"), b, F.col("l_quantity").alias("q"))
    new = li.where("l_orderkey % 9 <> 0").select(F.when(k % 50 != 7, a).alias("a"), b, (F.col("l_quantity") + F.when(k % 7 == 0, 1).otherwise(0)).alias("q"))
    return compare.record_changes(old, new, ["a", "b"]).groupBy("kind").agg(F.count("*").alias("n"))


_SIDE = "SELECT '{c}' AS path, 100.0 * count({c}) / count(*) AS coverage, count(DISTINCT {c}) AS d FROM ({t})"


@query("WITH a AS (" + " UNION ALL ".join(_SIDE.format(c=c, t=_OLD) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")) + "), b AS (" + " UNION ALL ".join(_SIDE.format(c=c, t=_NEW) for c in ("o_orderkey", "o_orderstatus")) + ") SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'common' END AS status, round(b.coverage - a.coverage, 6) AS delta FROM a FULL JOIN b ON a.path = b.path")
def schema_diff(spark, d):
    a, b = _two(spark, d)
    of = lambda t: profile.fields(analyze.counts_of(t), analyze.row_counts(t))
    return compare.profile_diff(of({"orders": a}), of({"orders": b.drop("o_totalprice")})).select("path", "status", F.round("delta", 6).alias("delta"))


@query("SELECT 'o_totalprice' AS path, 'field_removed' AS kind, 'fail' AS severity UNION ALL SELECT 'o_orderstatus', 'type_changed', 'fail'")
def schema_events(spark, d):
    a, _ = _two(spark, d)
    of = lambda t: profile.fields(analyze.counts_of(t), analyze.row_counts(t))
    new = a.select("o_orderkey", F.length("o_orderstatus").alias("o_orderstatus"))
    return drift.schema_findings(compare.profile_diff(of({"orders": a}), of({"orders": new}))).select("path", "kind", "severity")


@query("WITH a AS (" + " UNION ALL ".join(_SIDE.format(c=c, t=_OLD) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")) + "), b AS (" + " UNION ALL ".join(_SIDE.format(c=c, t=_NEW) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")) + ") SELECT path, round(0.3 * abs(b.coverage - a.coverage) / 100 + 0.2 * abs(a.d - b.d) / greatest(a.d, b.d), 9) AS divergence FROM a JOIN b USING (path)")
def deep_diff(spark, d):
    a, b = _two(spark, d)
    of = lambda t: profile.fields(analyze.counts_of(t), analyze.row_counts(t))
    return compare.deep_diff(of({"orders": a}), of({"orders": b})).select("path", F.round("divergence", 9).alias("divergence"))


@query("WITH a AS (" + " UNION ALL ".join(_SIDE.format(c=c, t=_OLD) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")) + "), b AS (" + " UNION ALL ".join(_SIDE.format(c=c, t=_NEW) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")) + ") SELECT path, round(a.coverage, 6) AS old_coverage, round(b.coverage, 6) AS new_coverage FROM a JOIN b USING (path) WHERE abs(b.coverage - a.coverage) >= 1 AND abs(b.coverage - a.coverage) / a.coverage * 100 >= 5")
def coverage_shifts(spark, d):
    a, b = _two(spark, d)
    of = lambda t: profile.fields(analyze.counts_of(t), analyze.row_counts(t))
    return drift.coverage_shifts(compare.profile_diff(of({"orders": a}), of({"orders": b}))).select("path", F.round("old_coverage", 6).alias("old_coverage"), F.round("new_coverage", 6).alias("new_coverage"))


_BY_DAY = "SELECT DISTINCT 'user' || user_id AS object FROM events WHERE day(ts) {w}"


@query(f"SELECT coalesce(a.object, b.object) AS object, CASE WHEN b.object IS NULL THEN 'removed' WHEN a.object IS NULL THEN 'added' ELSE 'common' END AS status FROM ({_BY_DAY.format(w='<= 3')}) a FULL JOIN ({_BY_DAY.format(w='>= 28')}) b ON a.object = b.object")
def object_sets(spark, d):
    """Users of the first and of the last days, as objects of two runs."""
    side = lambda when: table(spark, d, "events").where(when).select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("object"))
    return compare.object_diff(side("day(ts) <= 3"), side("day(ts) >= 28"))


# ---------------------------------------------------------------- contracts and the whole plan

EXPECTED = {
    "type": "object",
    "required": ["o_orderkey", "o_orderstatus", "sku"],
    "additionalProperties": False,
    "properties": {
        "o_orderkey": {"type": "integer", "minimum": 0},
        "o_orderstatus": {"type": "string", "enum": ["F", "O"]},
        "o_totalprice": {"type": "number", "minimum": 0, "maximum": 1000},
        "o_orderdate": {"type": "string", "format": "date"},
        "o_orderpriority": {"type": "string", "pattern": "^[0-9]-"},
        "sku": {"type": "string"},
    },
}


@query("""SELECT * FROM (SELECT 'o_orderkey' AS field, 'required' AS "check", 'pass' AS status UNION ALL SELECT 'o_orderkey', 'type', 'pass' UNION ALL SELECT 'o_orderkey', 'range', CASE WHEN (SELECT min(o_orderkey) FROM orders) < 0 THEN 'fail' ELSE 'pass' END
UNION ALL SELECT 'o_orderstatus', 'required', 'pass' UNION ALL SELECT 'o_orderstatus', 'type', 'pass' UNION ALL SELECT 'o_orderstatus', 'enum', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_orderstatus NOT IN ('F', 'O')) THEN 'fail' ELSE 'pass' END
UNION ALL SELECT 'o_totalprice', 'type', 'pass' UNION ALL SELECT 'o_totalprice', 'range', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0 OR o_totalprice > 1000) THEN 'fail' ELSE 'pass' END
UNION ALL SELECT 'o_orderdate', 'type', 'pass' UNION ALL SELECT 'o_orderdate', 'format', 'pass' UNION ALL SELECT 'o_orderpriority', 'type', 'pass'
UNION ALL SELECT 'o_orderpriority', 'pattern', CASE WHEN EXISTS (SELECT 1 FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-')) THEN 'fail' ELSE 'pass' END
UNION ALL SELECT 'sku', 'required', 'fail' UNION ALL SELECT 'o_custkey', 'unexpected_fields', 'warn')""")
def contract_checks_orders(spark, d):
    from .operators import contract

    counts, _ = _profile(spark, d, ("orders",))
    counts = counts.persist()  # the profile and the value rules both read them
    p = profile.fields(counts, counts.where("path = 'o_orderkey'").groupBy("object").agg(F.sum("n").alias("rows")))
    rows = contract.checks(p, counts, [contract.parse(EXPECTED, "orders")])
    counts.unpersist()
    return spark.createDataFrame([(r["field"], r["check"], r["status"]) for r in rows], "field string, check string, status string")


@query()
def analyze_all(spark, d):
    """The flagship plan over all tables, nested ones too: metrics of a run."""
    run = analyze.analyze({n: table(spark, d, n) for n in (*FLAT, "embeddings")}, "2024-01-01")
    return run.metrics


@query("SELECT date_trunc('hour', ts) AS window_start, 'row_count' AS metric, '' AS path, count(*)::DOUBLE AS value FROM events GROUP BY 1 UNION ALL SELECT date_trunc('hour', ts), 'coverage', 'event_type', 100.0 FROM events GROUP BY 1")
def windowed_profile_events(spark, d):
    from .streaming.windows import windowed_profile

    return windowed_profile(table(spark, d, "events"), "ts", ["event_type"])


_STREAMED = """WITH h AS (SELECT date_trunc('hour', ts) AS window_start, count(*)::DOUBLE AS value FROM events WHERE ts IS NOT NULL GROUP BY 1),
s AS (SELECT window_start, value, coalesce(list(value) OVER (ORDER BY window_start ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), []) AS seen FROM h),
m AS (SELECT *, list_aggregate(seen, 'median') AS median FROM s),
d AS (SELECT *, list_aggregate(list_transform(seen, lambda x: abs(x - median)), 'median') AS mad FROM m),
g AS (SELECT *, CASE WHEN greatest(1.4826 * mad, 0.05 * abs(median)) = 0 THEN 1e-9 ELSE greatest(1.4826 * mad, 0.05 * abs(median)) END AS sigma FROM d),
b AS (SELECT *, least(median - 3 * sigma, list_min(seen) - 0.05 * abs(list_min(seen))) AS lower, greatest(median + 3 * sigma, list_max(seen) + 0.05 * abs(list_max(seen))) AS upper FROM g)
SELECT 'row_count' AS metric, window_start, value, round(lower, 6) AS lower, round(upper, 6) AS upper, CASE WHEN len(seen) < 3 THEN 'cold' WHEN value BETWEEN lower AND upper THEN 'ok' WHEN abs(value - median) / sigma > 3 THEN 'fail' ELSE 'warn' END AS severity
FROM b WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""


@query(_STREAMED)
def streamed_bands_events(spark, d):
    """Events as a stream: row counts of finished hours against the bands they teach."""
    from .streaming.windows import finished, learned_bands, windowed_profile

    stream = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = finished(learned_bands(windowed_profile(stream, "ts", ["event_type"])))
    return got.where("metric = 'row_count'").select("metric", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "value", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "severity")


@query("SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) / count(*) * 100 AS coverage FROM orders")
def coverage_expression(spark, d):
    return table(spark, d, "orders").agg(scores.coverage_pct(F.count_if(F.col("o_orderstatus") == "F"), F.count("*")).alias("coverage"))


# ---------------------------------------------------------------- more of the inventory


@query("WITH a AS (SELECT DISTINCT o_orderstatus AS v FROM orders), b AS (SELECT DISTINCT l_linestatus AS v FROM lineitem) SELECT 'status' AS path, 'lineitem' AS a_object, 'orders' AS b_object, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) AS shared, count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) / count(*) AS jaccard, 'orders' AS recommended, true AS coverage_cliff FROM a FULL JOIN b ON a.v = b.v")
def similar_fields(spark, d):
    li = table(spark, d, "lineitem").select(F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linestatus")).alias("status"))
    t = {"orders": table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")), "lineitem": li}
    counts = analyze.counts_of(t)
    return relations.similar_fields(counts, settle(profile.fields(counts, analyze.row_counts(t))))


_METRIC_PARTS = [f"SELECT 'row_count' AS metric, '{t}' AS object, '' AS path, count(*)::DOUBLE AS value FROM {t}" for t in ("supplier", "nation")]
_METRIC_PARTS += [f"SELECT 'coverage', '{t}', '{c}', 100.0 * count({c}) / count(*) FROM {t}" for t in ("supplier", "nation") for c in COLUMNS[t]]
_METRIC_PARTS += ["SELECT 'distinct', 'nation', 'n_name', count(DISTINCT n_name)::DOUBLE FROM nation"]
_METRIC_PARTS += ["SELECT 'distinct', 'nation', 'n_regionkey', count(DISTINCT n_regionkey)::DOUBLE FROM nation", "SELECT 'distinct', 'nation', 'n_nationkey', count(DISTINCT n_nationkey)::DOUBLE FROM nation"]


@query("SELECT * FROM (" + " UNION ALL ".join(_METRIC_PARTS) + ")")
def run_metrics(spark, d):
    """The metrics of a run, but for derived scores."""
    t = {"supplier": table(spark, d, "supplier"), "nation": table(spark, d, "nation")}
    counts = analyze.counts_of(t)
    p = settle(profile.fields(counts, analyze.row_counts(t)))
    refs = relations.references(counts, p)
    m = analyze.run_metrics(p, refs, quality.object_quality(p, "2024-01-01"), [("supplier", "s_nationkey")])
    return m.where("metric in ('row_count', 'coverage') or (metric = 'distinct' and object = 'nation')")


@query("SELECT 'o_orderstatus' AS path, list_sort(list(DISTINCT o_orderstatus)) AS categories FROM orders UNION ALL SELECT 'o_orderpriority', list_sort(list(DISTINCT o_orderpriority)) FROM orders")
def category_sets(spark, d):
    """Value sets of category-like fields, kept with each run."""
    t = {"orders": table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")}
    counts = analyze.counts_of(t)
    low = profile.fields(counts, analyze.row_counts(t)).where("low_cardinality").select("object", "path")
    return counts.join(low, ["object", "path"]).groupBy("path").agg(F.array_sort(F.collect_set("value")).alias("categories"))


_NOISE = "SELECT n, old, new, abs(new - old) <= 3 * sqrt(2) * (100 * sqrt(greatest((old + new) / 200 * (1 - (old + new) / 200), 1.0 / (4 * n * n)) / n)) AS within_noise FROM (SELECT CAST(o_custkey % 1000 + 20 AS DOUBLE) AS n, CAST(o_orderkey % 97 AS DOUBLE) AS old, CAST((o_orderkey * 7) % 97 AS DOUBLE) AS new FROM orders)"


@query(f"SELECT within_noise, count(*) AS n FROM ({_NOISE}) GROUP BY 1")
def coverage_noise(spark, d):
    o = table(spark, d, "orders").select((F.col("o_custkey") % 1000 + 20).cast("double").alias("n"), (F.col("o_orderkey") % 97).cast("double").alias("old"), ((F.col("o_orderkey") * 7) % 97).cast("double").alias("new"))
    return o.groupBy(drift.within_noise(F.col("old"), F.col("new"), F.col("n"), F.col("n")).alias("within_noise")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 200")
def paired_sample_keys(spark, d):
    """The keys that both sides of a sampled record comparison keep."""
    a, b = _two(spark, d)
    x, y = compare.sampled_pair(a, b, ["o_orderkey"], 200)
    return x.select("o_orderkey").union(y.select("o_orderkey")).distinct()


@query("SELECT 'o_orderstatus' AS path, list_value('string') AS types UNION ALL SELECT 'o_mixed', list_value('date', 'string') UNION ALL SELECT 'o_rare', list_value('string')")
def material_types(spark, d):
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select("o_orderstatus", F.when(k % 2 == 0, "2024-01-01").otherwise("x").alias("o_mixed"), F.when(k % 500 == 0, "2024-01-01").otherwise("x").alias("o_rare"))
    counts = profile.value_counts(walk.typed_nodes(t, "orders"))
    p = profile.fields(counts, t.agg(F.lit("orders").alias("object"), F.count("*").alias("rows")))
    return p.select("path", profile.material_types(F.col("types")).alias("types"))


@query("SELECT o_orderkey, CAST(o_orderkey % 5 AS BIGINT) AS a_b, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS xs_first FROM orders")
def flatten_leaves(spark, d):
    """Leaves of nested records: of an array of objects, the first one counts."""
    k = F.col("o_orderkey")
    nested = table(spark, d, "orders").select(k, F.struct((k % 5).alias("b")).alias("a"), F.when(k % 3 == 0, F.array().cast("array<struct<s:string>>")).otherwise(F.array(F.struct(F.col("o_orderstatus").alias("s")), F.struct(F.lit("z").alias("s")))).alias("xs"))
    leaf = dict(compare.leaves(nested))
    return nested.select(k, leaf["a.b"].cast("long").alias("a_b"), leaf["xs[].s"].alias("xs_first"))


@query(f"{_DAYS}, {_MOVED.format(now=_LAST, then=_FIRST)} SELECT kind, object, path, severity, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'fail' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END, CASE kind WHEN 'row_count' THEN 1 WHEN 'coverage' THEN 2 ELSE 3 END, object, path) AS INTEGER) AS place FROM t WHERE severity <> 'ok'")
def finding_order(spark, d):
    return drift.placed(_day_findings(spark, d, "baseline:first")).select("kind", "object", "path", "severity", "place")


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 90 THEN 'A' WHEN s_acctbal >= 80 THEN 'B' WHEN s_acctbal >= 70 THEN 'C' WHEN s_acctbal >= 60 THEN 'D' ELSE 'F' END AS grade FROM supplier")
def grades(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", scores.grade_column(F.col("s_acctbal")).alias("grade"))


@query("SELECT 'tags[].k' AS path, count(*) FILTER (o_orderkey % 4 > 0) AS presence, CAST(sum(o_orderkey % 4) AS BIGINT) AS elements FROM orders")
def nested_array_fields(spark, d):
    k = F.col("o_orderkey") % 4
    t = table(spark, d, "orders").select(F.when(k > 0, F.transform(F.sequence(F.lit(1), k.cast("int")), lambda i: F.struct(i.alias("k")))).otherwise(F.array().cast("array<struct<k:int>>")).alias("tags"))
    n = walk.typed_nodes(t, "orders").where("path = 'tags[].k'")
    return n.groupBy("path").agg(F.sum("present").cast("long").alias("presence"), F.count("*").alias("elements"))


_DATED = "count(*) FILTER (TRY_CAST(CAST({c} AS VARCHAR) AS TIMESTAMP) IS NOT NULL) > 0"
_NUMBERED = "count(*) FILTER (TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) IS NOT NULL) > 0"
_SUMMARISED = ("nation", "supplier", "orders")


@query("SELECT object, count(*) FILTER (numbered) AS numeric_fields, count(*) FILTER (dated) AS temporal_fields FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS object, {_NUMBERED.format(c=c)} AS numbered, {_DATED.format(c=c)} AS dated FROM {t}" for t in _SUMMARISED for c in COLUMNS[t]) + ") GROUP BY ROLLUP (object)")
def statistics_summary(spark, d):
    return profile.statistics_summary(_profile(spark, d, _SUMMARISED)[1])


_SERIES = "SELECT DISTINCT date_trunc('hour', ts) AS run, event_type || '-' || (user_id % 50) AS path FROM events"


@query(f"WITH o AS ({_SERIES}), r AS (SELECT run, row_number() OVER (ORDER BY run) AS i FROM (SELECT DISTINCT run FROM o)), k AS (SELECT i, path FROM o JOIN r USING (run)) SELECT r.run, k.path, bool_or(k.i = r.i) AS present, count(*) FILTER (k.i < r.i) AS seen, CAST(least(r.i - 1, 14) AS INTEGER) AS runs FROM r JOIN k ON k.i BETWEEN r.i - 14 AND r.i GROUP BY r.run, r.i, k.path")
def seen_in_window(spark, d):
    """Series that come and go: each hour is a run."""
    h = table(spark, d, "events").select(F.date_trunc("hour", "ts").alias("run"), F.concat("event_type", F.lit("-"), (F.col("user_id") % 50).cast("string")).alias("path"))
    return drift.seen_in_window(h, "run", ["path"])


_DELTA = "current - (SELECT value FROM h WHERE h.object = x.object AND h.day = (SELECT max(day) FROM h WHERE day <= (SELECT max(day) FROM h) - {n})) AS delta_{n}"
_TIMES = "SELECT strftime(ts, '%Y%m%d') AS tag, CAST(ts AS DATE) AS day, event_type AS object, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL"


@query(f"WITH h AS ({_TIMES}), p AS (SELECT object, value, day, row_number() OVER (PARTITION BY object ORDER BY day DESC) AS back FROM h), c AS (SELECT object, value AS current FROM h WHERE day = (SELECT max(day) FROM h)), x AS (SELECT object, list(value ORDER BY day) FILTER (back <= 30) AS points, min(value) FILTER (back > 1) AS low, max(value) FILTER (back > 1) AS high FROM p GROUP BY object HAVING count(*) > 1) SELECT x.object, points, low, high, current, " + ", ".join(_DELTA.format(n=n) for n in (1, 7, 30)) + " FROM x JOIN c ON x.object = c.object")
def timeline(spark, d):
    """Row counts by day and event type, as runs."""
    h = table(spark, d, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("tag"), F.to_date("ts").alias("day"), F.col("event_type").alias("object")).agg(F.count("*").cast("double").alias("value"))
    return drift.timeline(h, ["object"])


_ENUMS = "SELECT count(*) FILTER (a.v IS NOT NULL AND b.v IS NOT NULL) / count(*) AS jaccard FROM (SELECT DISTINCT o_orderstatus AS v FROM orders) a FULL JOIN (SELECT DISTINCT l_linestatus AS v FROM lineitem UNION SELECT 'P') b ON a.v = b.v"
_RELATED = "SELECT 'value_join' AS kind, 'customer' AS source, 'orders' AS target FROM s WHERE jaccard >= 0.15 OR contained >= 0.8"
_RELATED += f" UNION ALL SELECT 'shared_enum', 'events', 'orders' FROM ({_ENUMS}) WHERE jaccard >= 0.6 UNION ALL SELECT 'hierarchy', 'orders', 'orders'"


@query(_PAIR.format(a="customer", ac="c_custkey", b="orders", bc="o_custkey") + f", r AS ({_RELATED}) SELECT object, kind, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(1 - o) AS BIGINT) AS incoming FROM (SELECT source AS object, kind, 1 AS o FROM r UNION ALL SELECT target, kind, 0 FROM r) GROUP BY 1, 2")
def relationship_summary(spark, d):
    """Joins, shared value sets and parents, by object and kind."""
    orders = table(spark, d, "orders").select("o_custkey", F.col("o_orderstatus").alias("ostat"), F.concat(F.lit("p"), (F.col("o_custkey") % 7).cast("string")).alias("parent_key"))
    events = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("lstat")).union(spark.range(1).select(F.lit("P")))
    t = {"customer": table(spark, d, "customer").select("c_custkey"), "orders": orders, "events": events}
    counts = analyze.counts_of(t)
    return relations.relationship_summary(relations.relationships(counts, settle(profile.fields(counts, analyze.row_counts(t)))))
