"""Quality scores: per field, per dimension and object, overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_identifier

# Weights of the dimensions and of a field's parts.
WEIGHTS = {"completeness": 0.30, "consistency": 0.25, "uniqueness": 0.20, "validity": 0.25, "timeliness": 0.10, "granularity": 0.10, "accuracy": 0.15}
FIELD_WEIGHTS = {"completeness": 0.4, "consistency": 0.3, "validity": 0.3}
MIN_GRANULARITY_ROWS, NEUTRAL_TIMELINESS = 20, 70.0


def field_quality(profile: DataFrame) -> DataFrame:
    """Completeness (nested fields against the rows that hold their parent),
    consistency, validity and their weighted score, per field."""
    parent = F.when(F.col("path").contains("."), F.regexp_extract("path", r"^(.*)\.[^.]*$", 1))
    base = profile.select("object", F.col("path").alias("parent"), F.greatest(F.lit(1), F.col("filled")).alias("base"))
    rows = profile.withColumn("parent", parent).join(F.broadcast(base), ["object", "parent"], "left")  # one row per field
    of = F.coalesce("base", "rows")
    filled = F.map_filter("types", lambda t, n: t != "null")
    total = F.aggregate(F.map_values(filled), F.lit(0).cast("long"), lambda a, x: a + x)
    most = F.array_max(F.map_values(filled))
    completeness = F.when(of > 0, F.col("filled") / of * 100).otherwise(0.0)
    consistency = F.when(total > 0, most / total * 100).otherwise(100.0)
    # Among all types, null included, the most frequent one.
    string_first = F.map_contains_key("types", "string") & (F.element_at("types", "string") == F.array_max(F.map_values("types")))
    validity = 100.0 - F.when(string_first & (F.col("distinct") == 1) & (F.col("presence") > 10), 20.0).otherwise(0.0) - F.when((F.col("presence") > 0) & (F.col("null_empty") > 0.5 * F.col("presence")), 30.0).otherwise(0.0)
    out = rows.select("object", "path", completeness.alias("completeness"), consistency.alias("consistency"), validity.alias("validity"))
    return out.withColumn("score", sum((F.col(k) * w for k, w in FIELD_WEIGHTS.items()), F.lit(0.0)))


def uniqueness(profile: DataFrame) -> DataFrame:
    """Per object: how unique the best identifier-named top-level field is."""
    names = [r["path"] for r in profile.select("path").distinct().collect() if "." not in r["path"] and "[]" not in r["path"] and is_identifier(r["path"])]  # one row per name
    ratio = F.least(F.lit(1.0), F.col("distinct") / F.greatest(F.lit(1), F.col("filled")))
    best = F.max(F.when(F.col("path").isin(*names), ratio)) if names else F.lit(None).cast("double")
    score = F.when(F.col("best").isNull(), 100.0).when(F.col("best") >= 0.99, 100.0).otherwise(F.col("best") * 100)
    return profile.groupBy("object").agg(best.alias("best") if names else F.max(best).alias("best")).select("object", score.alias("uniqueness"))


def granularity(profile: DataFrame) -> DataFrame:
    """Per object: share of scalar fields that are neither constant nor, unless
    identifiers, nearly unique; null (not scored) below 20 rows."""
    ids = [r["path"] for r in profile.select("path").distinct().collect() if is_identifier(r["path"])]
    is_id = F.col("path").isin(*ids) if ids else F.lit(False)
    scalar = ~F.map_contains_key("types", "object") & ~F.map_contains_key("types", "array")
    fine = (F.col("distinct") > 1) & (is_id | (F.col("distinct") / F.col("rows") < 0.99))
    out = profile.groupBy("object").agg(F.max("rows").alias("rows"), F.count_if(scalar).alias("s"), F.count_if(scalar & fine).alias("ok"))
    return out.select("object", F.when(F.col("rows") < MIN_GRANULARITY_ROWS, None).when(F.col("s") == 0, 100.0).otherwise(F.col("ok") / F.col("s") * 100).alias("granularity"))


def timeliness_score(age_days: Column, future: Column | int = 0) -> Column:
    """100 - 25 log10(age + 1), less 5 per future date (40 at most)."""
    recency = F.greatest(F.lit(0.0), 100.0 - 25.0 * F.log10(F.greatest(F.lit(1.0), age_days + 1.0)))
    return F.greatest(F.lit(0.0), recency - F.least(F.lit(40.0), F.lit(future) * 5.0 if isinstance(future, int) else future * 5.0))


def timeliness(profile: DataFrame, as_of: str) -> DataFrame:
    """Per object with date-like fields: freshness of the newest date that is
    not in the future; unreadable dates score 70."""
    dated = profile.where(F.map_contains_key("types", "date") | F.lower("path").rlike("created|updated|timestamp|date"))
    newest = F.try_to_timestamp(F.substring("last_date", 1, 10), F.lit("yyyy-MM-dd"))
    age = F.datediff(F.to_date(F.lit(as_of)), newest)
    best = dated.groupBy("object").agg(F.min(F.when(age >= 0, age)).alias("age"))
    return best.select("object", F.when(F.col("age").isNull(), NEUTRAL_TIMELINESS).otherwise(timeliness_score(F.col("age"))).alias("timeliness"))


def object_quality(profile: DataFrame, as_of: str, accuracy: DataFrame | None = None) -> DataFrame:
    """Dimensions and DQI per object; dimensions without a score don't count."""
    f = field_quality(profile).groupBy("object").agg(F.avg("completeness").alias("completeness"), F.avg("consistency").alias("consistency"), F.avg("validity").alias("validity"), F.count_if(F.col("score") < 70).alias("problem_fields"))
    out = f.join(uniqueness(profile), "object").join(timeliness(profile, as_of), "object", "left").join(granularity(profile), "object")
    out = out.join(accuracy, "object", "left") if accuracy is not None else out.withColumn("accuracy", F.lit(None).cast("double"))
    scored = [(F.col(k), w) for k, w in WEIGHTS.items()]
    total = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in scored), F.lit(0.0))
    value = sum((F.coalesce(c, F.lit(0.0)) * w for c, w in scored), F.lit(0.0))
    return out.withColumn("dqi", value / total)


def overall(quality: DataFrame) -> DataFrame:
    return quality.agg(F.avg("dqi").alias("overall_dqi"), *(F.avg(k).alias(k) for k in WEIGHTS))


def pattern_conformance(shown: DataFrame, once: bool = False) -> DataFrame:
    """``object, path, pattern, conformance`` where at least 0.6 of a field's
    distinct shown values have a shape, with the dominant one marked. ``once``: each
    value is there once, so that values are counted where they lie."""
    from pyspark.sql import Window

    from ..functions.patterns import MIN_CONFORMANCE, PATTERNS

    values = shown.where("value is not null").select("object", "path", "value")
    hits = [F.count_if(F.col("value").rlike(rx)).alias(name) for name, rx in PATTERNS]
    per = (values if once else values.distinct()).groupBy("object", "path").agg(F.count("*").alias("total"), *hits)
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("pattern"), (F.col(name) / F.col("total")).alias("conformance")) for name, _ in PATTERNS)))
    out = per.select("object", "path", each.alias("x")).select("object", "path", "x.*").where(F.col("conformance") >= MIN_CONFORMANCE)
    w = Window.partitionBy("object", "path").orderBy(F.desc("conformance"), "pattern")
    return out.select("object", "path", "pattern", "conformance", (F.row_number().over(w) == 1).alias("dominant"))


def accuracy(conformance: DataFrame) -> DataFrame:
    return conformance.where("dominant").groupBy("object").agg((F.avg("conformance") * 100).alias("accuracy"))
