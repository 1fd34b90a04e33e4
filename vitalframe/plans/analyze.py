"""The flagship plan: profile tables, relate, score, compare, decide."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import privacy
from ..functions.names import is_identifier
from ..operators import compare, contract, drift, profile, quality, relations, runs, walk
from ..session import settle
from . import decide

MASK_CONFIDENCE = privacy.HIGH_RISK


@dataclass
class Run:
    """Tables and decisions of one analysis. ``counts`` and ``profile`` hold raw values
    and are never written; ``stored`` is what may be."""

    rows: DataFrame
    counts: DataFrame
    profile: DataFrame
    quality: DataFrame
    references: DataFrame
    pii: dict[str, Any]
    keys: dict[str, list[str]]
    health: dict[str, Any]
    metrics: DataFrame
    stored: runs.Stored
    findings: list[dict] = field(default_factory=list)
    checks: list[dict] = field(default_factory=list)
    actions: list[dict] = field(default_factory=list)

    def masked_values(self, k: int = profile.TOP_VALUES) -> DataFrame:
        """Top values with personal fields masked and merged."""
        top = profile.top_values(self.counts, k).select("object", "path", "value", "n")
        value = F.col("value")
        for f in self.pii["fields"]:
            if f["confidence"] >= MASK_CONFIDENCE:
                value = F.when((F.col("object") == f["object"]) & (F.col("path") == f["field"]), privacy.mask(F.col("value"), f["type"])).otherwise(value)
        return top.withColumn("value", value).groupBy("object", "path", "value").agg(F.sum("n").alias("n"))


def nodes_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = walk.typed_nodes(df, name)
        out = n if out is None else out.unionByName(n)
    if out is None:
        raise ValueError("no tables")
    return out


def counts_of(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Value counts of all tables: scalar columns by ``flat_counts``, the others node
    by node."""
    if not tables:
        raise ValueError("no tables")
    out = walk.flat_counts(dict(tables))
    for name, df in tables.items():
        rest = [f"`{f.name}`" for f in df.schema.fields if not walk._scalar(f.dataType)]
        if rest:
            nested = profile.value_counts(walk.typed_nodes(df.select(*rest), name))
            out = nested if out is None else out.unionByName(nested)
    return next(iter(tables.values())).sparkSession.createDataFrame([], walk.COUNTS) if out is None else out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.lit(name).alias("object"), F.count("*").alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def detect_pii(counts: DataFrame, p: DataFrame, ignore: Sequence[str] = (), force: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Detections by name and by the share of distinct values of a personal shape."""
    spark = counts.sparkSession
    fields = [(r["object"], r["path"]) for r in p.select("object", "path").collect() if not privacy.listed(r["object"], r["path"], ignore)]  # one row per field
    forced = {f: (force or {})[by] for f in fields if (by := privacy.listed(*f, force or {}))}
    judged = [f for f in fields if f not in forced]
    texts = p.where(F.col("main_type").isin(*privacy.TEXT_TYPES)).select("object", "path").join(spark.createDataFrame(judged, "object string, path string"), ["object", "path"])
    ratios = counts.where("value is not null").join(F.broadcast(texts), ["object", "path"]).groupBy("object", "path").agg(*(privacy.value_ratio(F.col("value"), k).alias(k) for k in privacy.VALUE_SHAPES))
    shown = ratios.select("object", F.col("path").alias("field"), F.explode(F.array(*(F.struct(F.lit(k).alias("type"), F.col(k).alias("ratio")) for k in privacy.VALUE_SHAPES))).alias("x")).select("object", "field", "x.*")
    found = privacy.detections(spark.createDataFrame(privacy.name_hints(judged), privacy.HINTS), shown)
    known = [{"object": o, "field": f, "type": kind, "confidence": 1.0, "method": "config", "high_risk": True} for (o, f), kind in forced.items()]
    return privacy.summary([*known, *(r.asDict() for r in found.orderBy("object", "field", "type").collect())])  # few rows per field


def run_metrics(p: DataFrame, references: DataFrame, q: DataFrame, fk: Sequence[tuple[str, str]]) -> DataFrame:
    """(metric, object, path, value): row counts, coverage, distinct categories,
    orphan shares, quality per dimension and object."""
    rows = p.groupBy("object").agg(F.max("rows").alias("rows"))
    none = F.lit("")
    spark = p.sparkSession
    ids = [r["path"] for r in p.select("path").distinct().collect() if is_identifier(r["path"])]  # one row per name
    links = F.broadcast(spark.createDataFrame(list(fk), "object string, path string"))
    category = p.where("low_cardinality").where(~F.map_contains_key("types", "date")).where(~F.col("path").isin(*ids) if ids else F.lit(True)).join(links, ["object", "path"], "left_anti")
    parts = [
        rows.select(F.lit("row_count").alias("metric"), "object", none.alias("path"), F.col("rows").cast("double").alias("value")),
        rows.select(F.lit("sampled"), "object", none, F.col("rows").cast("double")),
        p.select(F.lit("coverage"), "object", "path", "coverage"),
        category.select(F.lit("distinct"), "object", "path", F.col("distinct").cast("double")),
        references.where("rank = 1").select(F.lit("orphan_pct"), F.col("child"), F.col("child_path"), F.col("orphan_pct")),
        q.select(F.lit("dqi"), "object", none, "dqi"),
        q.agg(F.avg("dqi").alias("d")).select(F.lit("dqi"), none, none, "d"),
    ]
    parts += [q.agg(F.avg(d).alias("d")).where("d is not null").select(F.lit("dqi"), none, F.lit(d), "d") for d in quality.WEIGHTS]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def analyze(
    tables: Mapping[str, DataFrame],
    as_of: str,
    expected: Sequence[contract.ExpectedObject] = (),
    reference: Run | runs.Past | None = None,
    rules: drift.Rules | None = None,
    pii_ignore: Sequence[str] = (),
    pii_force: Mapping[str, str] | None = None,
) -> Run:
    """Analyse a set of tables, and judge them against ``reference``: another run of
    this session, or stored runs (``History.past``). Value counts are kept (memory and
    disk) while the run lives; call ``counts.unpersist()`` when done."""
    # A mark of its own: a later run over the same paths must not meet this run's cache.
    counts = counts_of(tables).withColumn("run", F.lit(uuid.uuid4().hex)).drop("run").persist()
    rows = row_counts(tables)
    p = settle(profile.fields(counts, rows))
    fields = [r.asDict() for r in p.collect()]  # one row per field
    acc = quality.accuracy(quality.pattern_conformance(profile.distinct_values(counts, p), once=True))
    q = settle(quality.object_quality(p, as_of, acc))
    refs = settle(relations.references(counts, p))
    links = [r.asDict() for r in refs.where("rank = 1").collect()]  # one row per reference
    keys = relations.prefer_referenced(relations.primary_keys(tables, p), links)
    pii = detect_pii(counts, p, pii_ignore, pii_force)
    metrics = settle(run_metrics(p, refs, q, [(x["child"], x["child_path"]) for x in links]))
    checks = contract.checks(p, counts, expected) if expected else []
    spark: SparkSession = p.sparkSession
    personal = [(f["object"], f["field"], f["type"]) for f in pii["fields"] if f["confidence"] >= MASK_CONFIDENCE]
    personal = spark.createDataFrame(personal, "object string, path string, masked string").groupBy("object", "path").agg(F.min("masked").alias("masked"))
    linked = spark.createDataFrame([(x["child"], x["child_path"]) for x in links], "object string, path string")
    kept = settle(runs.stored_profile(counts, p, personal, linked))
    stored = runs.Stored(metrics, kept, settle(runs.kept_categories(counts, kept)))
    findings: list[dict] = []
    past: runs.Past | None = None
    if reference is not None:
        raw = isinstance(reference, Run)
        past = runs.Past(reference.stored) if raw else reference
        same = settle(drift.renames(compare.profile_diff(reference.profile, p), reference.counts, counts)) if raw else None
        findings = [r.asDict() for r in drift.ordered(runs.findings(stored, past, rules, same)).collect()]  # findings are few
    levels = {s: sum(f["severity"] == s for f in findings) for s in ("fail", "warn", "info")}
    mixed = [r.asDict() for r in profile.mixed_types(p).collect()]  # one row per mixed field
    dqi = q.agg(F.avg("dqi")).first()[0]
    verdict = decide.health(dqi, len(pii["high_risk_fields"]), decide.drift_severity(levels), sum(c["status"] == "fail" for c in checks), len(mixed))
    sparse = [f for f in fields if f["coverage"] < 80]
    actions = decide.next_steps({"pii": pii, "drift": findings, "contract": checks, "references": links, "mixed_types": mixed, "sparse": sparse})
    score = spark.createDataFrame([("health", "", "", float(verdict["score"]))], metrics.schema)
    if past is not None:
        findings += [r.asDict() for r in runs.metric_findings(score, past, rules).collect()]  # one at most
    stored.metrics = metrics.union(score)
    return Run(rows, counts, p, q, refs, pii, keys, verdict, stored.metrics, stored, findings, checks, actions)

