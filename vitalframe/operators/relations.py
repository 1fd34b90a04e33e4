"""Relations between fields, from value counts.

All field pairs are measured at once: value counts meet on (type signature,
value) in one shuffle and sort, and pairs are summed from there. Shared values of fields
are few columns wide, so a value row carries at most the number of fields that
hold it. Where a pair of fields is named, ``integrity`` is a plain left join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import identifier_bias, is_audit, useless_for_joins
from ..session import settle
from .keys import find_key

SIGNATURES = ("uuid", "numeric_id", "email", "url", "date", "int", "float", "string")


def signature(types: Column) -> Column:
    """Coarse type of a field from its type histogram."""
    out = F.lit(None).cast("string")
    for t in reversed(SIGNATURES):
        out = F.when(F.map_contains_key(types, t), t).otherwise(out)
    return F.coalesce(out, F.array_join(F.sort_array(F.map_keys(types)), ","))


def integrity(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """One row: occurrences, orphans, distinct orphans and the orphan share of a
    reference from ``child`` to ``parent``. Both sides are reduced to counts per
    value before they meet, so a hot key is one row."""
    c = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    p = parent.select(F.col(parent_key).alias("k")).where("k is not null").distinct().withColumn("hit", F.lit(1))
    m = c.join(p, "k", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("child_occurrences"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("orphan_occurrences"), F.count_if(F.col("hit").isNull()).alias("orphan_distinct")
    )
    return m.withColumn("orphan_pct", F.when(F.col("child_occurrences") > 0, 100.0 * F.col("orphan_occurrences") / F.col("child_occurrences")).otherwise(0.0))


def _facts(profile: DataFrame, ok: Column) -> DataFrame:
    """Eligible scalar fields. ``mixed``: a value may have several rows in the counts, as
    values of several types, or as numbers that share a text."""
    facts = profile.where(~F.map_contains_key("types", "object") & ~F.map_contains_key("types", "array")).where(ok)
    filled = F.map_filter("types", lambda t, n: t != "null")
    mixed = (F.size(filled) > 1) | F.map_contains_key(filled, "float")
    return facts.select("object", "path", signature(filled).alias("sig"), "coverage", "distinct", "rows", mixed.alias("mixed"))


def overlaps(counts: DataFrame, a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    """Per pair of fields of one ``sig``, from ``a`` and ``b``, that ``on`` allows (never a field
    with itself): shared values, and occurrences of either side in them. Fields that can
    pair with none are left out before values move; the others' values carry numbers for
    names, and meet in one shuffle."""
    a = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns))
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    allowed = a.join(b, F.col("a_sig") == F.col("b_sig")).where(on)
    ends = F.array(*(F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ("object", "path", "sig", "mixed")), F.lit(s == "a").alias("a")) for s in ("a", "b")))
    found = allowed.select(F.explode(ends).alias("e")).select("e.*").groupBy("object", "path", "sig", "mixed").agg(F.max("a").alias("a"), F.max(~F.col("a")).alias("b"))
    fields = sorted(tuple(r) for r in found.collect())  # one row per field
    sigs = {x: i for i, x in enumerate(sorted({f[2] for f in fields}))}
    table = [(i, o, p, sigs[s], *rest) for i, (o, p, s, *rest) in enumerate(fields)]
    ids = F.broadcast(counts.sparkSession.createDataFrame(table, "f int, object string, path string, s int, mixed boolean, a boolean, b boolean"))
    rows = counts.where("value is not null").join(ids, ["object", "path"]).select("s", "value", "f", "a", "b", "n", "mixed")
    once = rows.where("not mixed").drop("mixed") if any(f[3] for f in fields) else rows.drop("mixed")
    if any(f[3] for f in fields):
        once = once.unionByName(rows.where("mixed").groupBy("s", "value", "f", "a", "b").agg(F.sum("n").alias("n")))
    others = F.collect_list(F.when(F.col("b"), F.struct("f", "n"))).over(Window.partitionBy("s", "value"))
    met = once.withColumn("x", others).where("a").select("f", "n", F.explode("x").alias("x")).where("f <> x.f")
    met = met.groupBy(F.col("f").alias("a_f"), F.col("x.f").alias("b_f")).agg(F.count("*").alias("shared"), F.sum("n").alias("a_hits"), F.sum("x.n").alias("b_hits"))
    for side in ("a", "b"):
        met = met.join(ids.select(F.col("f").alias(f"{side}_f"), F.col("object").alias(f"{side}_object"), F.col("path").alias(f"{side}_path")), f"{side}_f")
    out = met.join(allowed, ["a_object", "a_path", "b_object", "b_path"])
    facts = [f"{s}_{c}" for s in ("a", "b") for c in ("object", "path", "coverage", "distinct", "rows")]
    return out.select("a_sig", *facts, "shared", "a_hits", "b_hits")


def _with_totals(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    totals = counts.where("value is not null").groupBy("object", "path").agg(F.sum("n").alias("n"))
    totals = settle(totals) if counts.is_cached else totals  # one row per field, read twice
    for side in ("a", "b"):
        t = totals.select(F.col("object").alias(f"{side}_object"), F.col("path").alias(f"{side}_path"), F.col("n").alias(f"{side}_total"))
        pairs = pairs.join(F.broadcast(t), [f"{side}_object", f"{side}_path"])  # one row per field
    union = F.col("a_distinct") + F.col("b_distinct") - F.col("shared")
    return pairs.withColumns({"jaccard": F.col("shared") / union, "contained": F.greatest(F.col("a_hits") / F.col("a_total"), F.col("b_hits") / F.col("b_total"))})


def _flag(paths: Sequence[tuple[str, bool]], col: Column) -> Column:
    yes = [p for p, ok in paths if ok]
    return col.isin(*yes) if yes else F.lit(False)


def _names(profile: DataFrame) -> list[str]:
    return [r["path"] for r in profile.select("path").distinct().collect()]  # one row per field name


def references(counts: DataFrame, profile: DataFrame, least: float = 0.5) -> DataFrame:
    """All candidate references child -> unique parent, ranked per child."""
    names = _names(profile)
    audit, biased = [(p, is_audit(p)) for p in names], [(p, identifier_bias(p) > 1) for p in names]
    unique = (F.col("coverage") >= 95) & (F.col("distinct") >= 0.95 * F.col("rows")) & ~F.col("path").contains(".") & ~F.col("path").contains("[]")
    child = _facts(profile, ~_flag(audit, F.col("path")) & (F.col("distinct") >= 3))
    child = child.where(~F.col("sig").isin("int", "float") | _flag(biased, F.col("path"))).where("sig != 'date'")
    parent = _facts(profile, unique)
    pairs = _with_totals(overlaps(counts, child, parent, F.col("a_object") != F.col("b_object")), counts)
    resolved = F.col("a_hits") / F.col("a_total")
    enough = F.col("shared") >= F.least(F.lit(10), F.greatest(F.lit(2), F.floor(F.col("b_distinct") / 2)))
    rank = F.row_number().over(Window.partitionBy("a_object", "a_path").orderBy(F.desc("resolved"), "b_object", "b_path"))
    return (
        pairs.withColumn("resolved", resolved)
        .where(enough & (F.col("resolved") >= least))
        .select(
            F.col("a_object").alias("child"), F.col("a_path").alias("child_path"), F.col("b_object").alias("parent"), F.col("b_path").alias("parent_path"),
            F.col("a_total").alias("child_occurrences"), (F.col("a_total") - F.col("a_hits")).alias("orphan_occurrences"), (F.col("a_distinct") - F.col("shared")).alias("orphan_distinct"),
            ((1 - F.col("resolved")) * 100).alias("orphan_pct"), rank.alias("rank"),
        )
    )


def joins(counts: DataFrame, profile: DataFrame, least_jaccard: float = 0.15, least_contained: float = 0.8, k: int = 30) -> DataFrame:
    """Join candidates between objects that values confirm; best per object pair."""
    names = _names(profile)
    useless, biased = [(p, useless_for_joins(p)) for p in names], [(p, identifier_bias(p) > 1) for p in names]
    side = _facts(profile, ~_flag(useless, F.col("path")) & (F.col("coverage") >= 60) & (F.col("distinct") >= 5)).where("sig != 'date'")
    pairs = _with_totals(overlaps(counts, side, side, F.col("a_object") < F.col("b_object")), counts)
    same = F.regexp_replace("a_path", r"\[\]", "") == F.regexp_replace("b_path", r"\[\]", "")
    a_id, b_id = _flag(biased, F.col("a_path")), _flag(biased, F.col("b_path"))
    shaped = (F.col("contained") >= least_contained) & (a_id | b_id | same)
    depth = F.greatest(F.length(F.regexp_replace("a_path", r"[^.]", "")), F.length(F.regexp_replace("b_path", r"[^.]", "")))
    strength = F.greatest(F.col("jaccard"), F.when(shaped, F.col("contained")).otherwise(0.0))
    confidence = F.least(F.lit(1.0), F.least(F.lit(1.0), F.least(F.lit(1.0), strength * 0.7 + F.least("a_coverage", "b_coverage") / 100 * 0.3) + F.when(a_id | b_id, 0.12).otherwise(0.0)) + F.when(same, 0.05).otherwise(0.0))
    fit = pairs.where(~F.col("a_sig").isin("int", "float") | same | (a_id & b_id)).where((F.col("jaccard") >= least_jaccard) | shaped)
    fit = fit.select("a_object", "a_path", "b_object", "b_path", "jaccard", "contained", confidence.alias("confidence"), same.alias("same_path"), depth.alias("depth")).where("depth <= 1")
    best = Window.partitionBy("a_object", "b_object").orderBy("depth", F.desc("confidence"), "a_path", "b_path")
    return fit.withColumn("i", F.row_number().over(best)).where("i = 1").drop("i", "depth").orderBy(F.desc("confidence"), "a_object", "b_object").limit(k)


def shared_enums(counts: DataFrame, profile: DataFrame, least: float = 0.6) -> DataFrame:
    """Pairs of small value sets in different objects that agree."""
    names = _names(profile)
    side = _facts(profile, (F.col("distinct") >= 2) & (F.col("distinct") <= 50) & (F.col("coverage") >= 50) & ~_flag([(p, useless_for_joins(p) or identifier_bias(p) > 1) for p in names], F.col("path")))
    pairs = _with_totals(overlaps(counts, side.withColumn("sig", F.lit("")), side.withColumn("sig", F.lit("")), F.col("a_object") < F.col("b_object")), counts)
    return pairs.where(F.col("jaccard") >= least).select("a_object", "a_path", "b_object", "b_path", "jaccard", "shared")


def same_values(counts: DataFrame, profile: DataFrame, least: float = 0.6) -> DataFrame:
    """Field pairs of one object whose value sets agree."""
    names = _names(profile)
    side = _facts(profile, ~_flag([(p, is_audit(p)) for p in names], F.col("path")) & (F.col("coverage") >= 50) & (F.col("distinct") >= 3)).where("sig != 'date'")
    pairs = _with_totals(overlaps(counts, side, side, (F.col("a_object") == F.col("b_object")) & (F.col("a_path") < F.col("b_path"))), counts)
    return pairs.where(F.col("jaccard") >= least).select(F.col("a_object").alias("object"), F.col("a_path").alias("field_a"), F.col("b_path").alias("field_b"), "jaccard", F.col("a_coverage").alias("coverage_a"), F.col("b_coverage").alias("coverage_b"))


def row_equality(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Share of rows (both filled) in which two fields hold the same value."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [F.count_if(both).alias(f"b{i}"), F.count_if(both & (F.col(a) == F.col(b))).alias(f"e{i}")]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.col(f"b{i}").alias("both"), F.col(f"e{i}").alias("equal")) for i, (a, b) in enumerate(pairs))))
    return one.select(rows.alias("r")).select("r.*").withColumn("row_equality", F.when(F.col("both") > 0, F.col("equal") / F.col("both")))


def duplicates(df: DataFrame, candidates: Sequence[tuple[str, str, float, float]], least: float = 0.9) -> DataFrame:
    """Duplicates and shared domains: (field_a, field_b, jaccard, least coverage)
    with row equality; ``kind`` is ``duplicate`` or ``shared_domain``."""
    spark = df.sparkSession
    known = spark.createDataFrame(list(candidates), "field_a string, field_b string, jaccard double, coverage double")
    out = row_equality(df, [(a, b) for a, b, *_ in candidates]).join(F.broadcast(known), ["field_a", "field_b"])
    base = F.least(F.lit(1.0), F.col("jaccard") * 0.8 + F.col("coverage") * 0.2)
    same = F.col("row_equality") >= least
    return out.select("field_a", "field_b", "jaccard", "row_equality", F.when(same, "duplicate").otherwise("shared_domain").alias("kind"), F.when(same, F.least(F.lit(1.0), base * 0.5 + F.col("row_equality") * 0.5)).otherwise(base).alias("confidence"))


def uniqueness(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct tuples and whether the (composite) key is unique."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"), F.count_if(F.col("n") > 1).alias("repeated")).withColumn("unique", F.col("rows") == F.col("distinct"))


def primary_keys(tables: Mapping[str, DataFrame], profile: DataFrame, least: float = 0.95) -> dict[str, list[str]]:
    """A key per object. A field that is nearly always filled and nearly always
    different is one; identifier-like names come first, then the more distinct.
    Where there is none, the smallest and best-named set of fields that is unique in
    at least ``least`` of the rows is taken (``keys.find_key``): of fields filled in half
    of the rows, or with those that record who and when, where it takes them."""
    flat = profile.where(~F.col("path").rlike(r"[.\[]") & ~F.map_contains_key("types", "object") & ~F.map_contains_key("types", "array") & (F.col("rows") > 0) & (F.col("main_type") != "null"))
    facts = flat.select("object", "path", "rows", "types", "distinct", (F.col("coverage") / 100).alias("filled"), (F.col("distinct") / F.col("rows")).alias("ratio")).collect()  # one row per field
    out: dict[str, list[str]] = {}
    for obj in sorted({r["object"] for r in facts}):
        every = [(r["path"], r["filled"], r["ratio"], identifier_bias(r["path"]), is_audit(r["path"], set(r["types"]))) for r in facts if r["object"] == obj]
        sure = sorted((-bias, -ratio, -filled, path) for path, filled, ratio, bias, audit in every if not audit and filled >= 0.95 and ratio >= 0.95)
        if sure:
            out[obj] = [sure[0][-1]]
            continue
        if obj not in tables:
            continue
        held = set(tables[obj].columns)
        telling = [(audit, p) for audit, _, p in sorted((audit, -filled * ratio * bias, p) for p, filled, ratio, bias, audit in every if filled >= 0.5 and ratio > 0 and p in held)]
        plain = [p for audit, p in telling if not audit]
        key = find_key(tables[obj], plain, least)
        if key is None and len(plain) < len(telling):
            key = find_key(tables[obj], [p for _, p in telling], least)
        if key:
            out[obj] = key
    return out


def prefer_referenced(keys: dict[str, list[str]], links: Sequence[dict]) -> dict[str, list[str]]:
    """Where several fields are unique, take the one that others refer to most."""
    refs: dict[tuple[str, str], int] = {}
    for x in links:
        refs[x["parent"], x["parent_path"]] = refs.get((x["parent"], x["parent_path"]), 0) + 1
    out = {}
    for obj, key in keys.items():
        best = max(((n, p) for (o, p), n in refs.items() if o == obj), default=None)
        now = refs.get((obj, key[0]), 0) if len(key) == 1 else 0
        out[obj] = [best[1]] if best and best[1] not in key and best[0] > now else key
    return out


def naming_references(objects: dict[str, Sequence[str]]) -> list[dict]:
    """References by name: ``<entity>_id`` or ``<entity>id`` to an object."""
    singular = {o.lower().rstrip("s"): o for o in objects} | {o.lower(): o for o in objects}
    out = []
    for obj, paths in objects.items():
        for path in paths:
            name = path.split(".")[-1].lower()
            entity = name[:-3] if name.endswith("_id") else name[:-2] if name.endswith("id") and len(name) > 2 else ""
            target = singular.get(entity) or singular.get(entity.rstrip("s"))
            if entity and target and target != obj:
                out.append({"child": obj, "child_path": path, "parent": target, "confidence": 0.7})
    return out


def hierarchies(objects: dict[str, Sequence[str]]) -> list[dict]:
    """Fields that point to a parent in the same object."""
    shaped = lambda n: n == "parent" or (n.startswith("parent") and n.endswith(("id", "key")))
    return [{"object": o, "path": p, "confidence": 0.8} for o, ps in objects.items() for p in ps if shaped(p.split(".")[-1].lower().replace("_", ""))]


RELATIONS = "kind string, source string, source_path string, target string, target_path string, confidence double"


def relationships(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """All relations found: joins that values confirm, shared value sets, and fields
    that point to a parent in their own object."""
    row = lambda df, kind, sure: df.select(F.lit(kind).alias("kind"), F.col("a_object").alias("source"), F.col("a_path").alias("source_path"), F.col("b_object").alias("target"), F.col("b_path").alias("target_path"), F.col(sure).alias("confidence"))
    paths = {r["object"]: r["paths"] for r in profile.groupBy("object").agg(F.sort_array(F.collect_list("path")).alias("paths")).collect()}  # field names
    up = [("hierarchy", h["object"], h["path"], h["object"], None, h["confidence"]) for h in hierarchies(paths)]
    return row(joins(counts, profile), "value_join", "confidence").unionByName(row(shared_enums(counts, profile), "shared_enum", "jaccard")).unionByName(counts.sparkSession.createDataFrame(up, RELATIONS))


def relationship_summary(found: DataFrame) -> DataFrame:
    """Relations that leave and that reach each object, by kind."""
    ends = found.select("kind", F.explode(F.array(F.struct(F.col("source").alias("object"), F.lit(1).alias("out")), F.struct(F.col("target").alias("object"), F.lit(0).alias("out")))).alias("e"))
    return ends.groupBy("e.object", "kind").agg(F.sum("e.out").alias("outgoing"), F.sum(1 - F.col("e.out")).alias("incoming"))


def similar_fields(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """Low-cardinality fields of one name in several objects: shared values, the
    side to prefer (more values, then fuller), and whether coverage falls off
    between them (40 points). Case and array marks in names don't matter."""
    name = F.lower(F.regexp_replace("path", r"\[\]", ""))
    side = _facts(profile, F.col("low_cardinality")).withColumn("sig", name)
    pairs = _with_totals(overlaps(counts, side, side, F.col("a_object") < F.col("b_object")), counts)
    better = F.struct("a_distinct", "a_coverage") >= F.struct("b_distinct", "b_coverage")
    fuller = F.when(better, F.col("a_object")).otherwise(F.col("b_object"))
    return pairs.select(F.col("a_path").alias("path"), "a_object", "b_object", "shared", "jaccard", fuller.alias("recommended"), (F.abs(F.col("a_coverage") - F.col("b_coverage")) > 40).alias("coverage_cliff"))
