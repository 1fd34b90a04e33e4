"""The profile: aggregations over nodes.

``value_counts`` is the one large shuffle, pre-aggregated on the map side by
(object, path, type, value); coverage, type histograms, exact distinct counts,
top values and low-cardinality flags all come from it. Quantiles are exact, and no
task holds a field's distinct values for them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import coverage_pct
from ..functions.values import parse_date
from . import quantiles

LOW_CARDINALITY, TOP_VALUES, EXAMPLES, QUANTILE_STEP = 50, 20, 3, 5
#: One value in so many makes the part that bounds the first k.
PART = 1024
KEY = ("object", "path")
FUTURE = "future"


def value_counts(nodes: DataFrame) -> DataFrame:
    """``object, path, type, value, number, present, empty, n``."""
    return nodes.groupBy("object", "path", "type", "value", "number").agg(F.sum("present").alias("present"), F.sum("empty").alias("empty"), F.count("*").alias("n"))


def fields(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per field: presence, emptiness, coverage, distinct values, types.

    ``rows``: (object, rows), the record counts, one row per object.
    """
    _date = F.when(F.col("type") == "date", F.col("value"))
    per_type = counts.groupBy(*KEY, "type").agg(
        F.sum("present").alias("present"), F.sum("empty").alias("empty"), F.sum("n").alias("n"), F.count("value").alias("values"), F.min(_date).alias("lo"), F.max(_date).alias("hi")
    )
    out = per_type.groupBy(*KEY).agg(
        F.sum("present").alias("presence"),
        F.sum("empty").alias("null_empty"),
        F.sum("values").alias("distinct"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "n")))).alias("types"),
        F.max_by("type", F.struct((F.col("type") != "null").cast("int"), "n", "type")).alias("main_type"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
    )
    filled = F.col("presence") - F.col("null_empty")
    return out.join(F.broadcast(rows), "object").select(  # one row per object
        *KEY, "rows", "presence", "null_empty", filled.alias("filled"), coverage_pct(filled, F.col("rows")).alias("coverage"), "distinct",
        (F.col("distinct") <= LOW_CARDINALITY).alias("low_cardinality"), "types", "main_type", "first_date", "last_date",
    )


def type_histogram(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*KEY, "type").agg(F.sum("n").alias("n"))


def top_values(counts: DataFrame, k: int = TOP_VALUES) -> DataFrame:
    """The k most frequent values of each field, ties by value. Kept counts are read
    twice more to put but few of them in order (``_in_reach``)."""
    w = Window.partitionBy(*KEY).orderBy(F.desc("n"), "value")
    first = lambda rows: rows.groupBy(*KEY, "value").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    filled = counts.where("value is not null")
    return first(_in_reach(filled, first(filled.where(F.pmod(F.xxhash64("value"), F.lit(PART)) == 0)).where(F.col("rank") == k)) if counts.is_cached else filled)


def distinct_values(counts: DataFrame, profile: DataFrame) -> DataFrame:
    """Each value of a field once. Only values that may have several rows in the counts (of
    several types, or numbers that share a text) are shuffled to be put together."""
    filled = F.map_filter("types", lambda t, n: t != "null")
    mixed = profile.select(*KEY, ((F.size(filled) > 1) | F.map_contains_key(filled, "float")).alias("mixed"))
    rows = counts.where("value is not null").join(F.broadcast(mixed), [*KEY]).select(*KEY, "value", "mixed")  # one row per field
    return rows.where("not mixed").drop("mixed").unionByName(rows.where("mixed").drop("mixed").distinct())


def _in_reach(filled: DataFrame, last: DataFrame) -> DataFrame:
    """``filled`` without what can't be among the first k. ``last``: the k-th of one part of a
    field's values; the k-th of all comes no later. Nothing is left out of fields without
    a ``last``, nor of those in which a value may have several rows (types, or numbers that
    share a text), as one row's count is not the value's."""
    odd = (F.col("type") == "float") & ~F.col("number").eqNullSafe(F.col("value").try_cast("double"))
    per_type = filled.groupBy(*KEY, "type").agg(F.count_if(odd).alias("odd"))
    single = per_type.groupBy(*KEY).agg(F.count("*").alias("kinds"), F.sum("odd").alias("odd")).where("kinds = 1 and odd = 0")
    bound = last.select(*KEY, F.col("n").alias("__n"), F.col("value").alias("__value")).join(single.select(*KEY), [*KEY])
    ahead = F.col("__n").isNull() | (F.col("n") > F.col("__n")) | ((F.col("n") == F.col("__n")) & (F.col("value") <= F.col("__value")))
    return filled.join(F.broadcast(bound), [*KEY], "left").where(ahead).drop("__n", "__value")  # one row per field


def examples(counts: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """Up to k distinct values of each field, in value order (repeatable)."""
    w = Window.partitionBy(*KEY).orderBy("value")
    return counts.where("value is not null").select(*KEY, "value").distinct().withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy(*KEY).agg(F.sort_array(F.collect_list("value")).alias("examples"))


def numeric(source: DataFrame, keys: Sequence[str], value: Column, weight: Column | None = None) -> DataFrame:
    """Count, mean, population deviation, extremes and 21 exact quantiles (see ``quantiles``:
    they are worked out at once, over a few passes)."""
    w = F.lit(1) if weight is None else weight
    rows = source.select(*keys, value.cast("double").alias("x"), w.cast("long").alias("w")).where("x is not null and not isnan(x) and abs(x) < double('infinity')")
    mean = F.sum(F.col("x") * F.col("w")) / F.sum("w")
    square = F.sum(F.col("x") * F.col("x") * F.col("w")) / F.sum("w")
    spread = F.stddev_pop("x") if weight is None else F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))
    out = rows.groupBy(*keys).agg(F.sum("w").alias("count"), mean.alias("mean"), spread.alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    return _with_quantiles(out, rows, keys, [q / 100 for q in range(0, 101, QUANTILE_STEP)])


def _with_quantiles(out: DataFrame, rows: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """``out``, a row per group, with the exact ``quantiles`` of the rows' ``x``."""
    found = F.broadcast(quantiles.exact(rows, keys, points).withColumnsRenamed({k: f"__{k}" for k in keys}))  # a row per group
    return out.join(found, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys], "left").drop(*(f"__{k}" for k in keys))


def numeric_stats(source: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Sample deviation, five quantiles, counts by sign and a skew label."""
    rows = source.select(*keys, value.cast("double").alias("x"), F.lit(1).cast("long").alias("w")).where("x is not null and not isnan(x)")
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("stddev"),
        F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") < 0).alias("negatives"), F.count_if(F.col("x") > 0).alias("positives"),
    )
    out = _with_quantiles(out, rows, keys, (0.25, 0.5, 0.75, 0.95, 0.99)).withColumnRenamed("quantiles", "q")
    median = F.col("q")[1]
    label = (
        F.when(F.col("count") < 10, "unknown").when(F.abs(F.col("mean") - median) < 0.01 * F.abs(F.col("mean")), "uniform").when(F.col("mean") > median, "skewed_right").otherwise("skewed_left")
    )
    return out.select(*keys, "count", "min", "max", "mean", "stddev", F.col("q")[0].alias("p25"), median.alias("p50"), F.col("q")[2].alias("p75"), F.col("q")[3].alias("p95"), F.col("q")[4].alias("p99"), "zeros", "negatives", "positives", label.alias("distribution"))


def temporal(source: DataFrame, keys: Sequence[str], when: Column, as_of: str) -> DataFrame:
    """Range, span, nulls, dates after ``as_of`` and a histogram by month."""
    stamp = when if dict(source.select(when.alias("w")).dtypes)["w"].startswith(("timestamp", "date")) else parse_date(when)
    rows = source.select(*keys, stamp.cast("timestamp").alias("t"))
    by_month = rows.groupBy(*keys, F.date_format("t", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.count_if(F.col("t") > F.to_timestamp(F.lit(as_of))).alias(FUTURE)
    )
    months = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "n")))))
    return by_month.groupBy(*keys).agg(
        F.min("lo").alias("first"), F.max("hi").alias("last"), F.datediff(F.max("hi"), F.min("lo")).alias("span_days"),
        F.coalesce(F.sum(F.when(F.col("month").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.sum(FUTURE).alias(FUTURE), months.alias("months"),
    )


def nested(profile: DataFrame) -> DataFrame:
    """Arrays of objects: parents with their number of fields and mean coverage."""
    parent = F.regexp_extract("path", r"^(.*\[\])\.", 1)
    return profile.where(parent != "").groupBy("object", parent.alias("parent")).agg(F.count("*").alias("child_count"), F.avg("coverage").alias("avg_coverage"))


def co_null_groups(profile: DataFrame, least_rows: int = 20) -> DataFrame:
    """Fields of one object that are present and empty equally often."""
    return (
        profile.where((F.col("rows") >= least_rows) & (F.col("null_empty") > 0))
        .groupBy("object", "presence", "null_empty")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"), F.count("*").alias("fields"))
        .where("fields >= 2")
    )


def cardinality_label(profile: DataFrame) -> DataFrame:
    nested_ = F.map_contains_key("types", "object") | F.map_contains_key("types", "array")
    label = F.when(nested_, "n/a").when(F.col("distinct") <= LOW_CARDINALITY, "low").when(F.col("distinct") > 0.3 * F.col("presence"), "high").otherwise("medium")
    return profile.select(*KEY, label.alias("cardinality"))


def heatmap(profile: DataFrame) -> DataFrame:
    """Coverage of each path in each object, with its band."""
    band = F.when(F.col("coverage") >= 90, "90+").when(F.col("coverage") >= 75, "75-90").when(F.col("coverage") >= 50, "50-75").when(F.col("coverage") >= 25, "25-50").otherwise("0-25")
    return profile.select("path", "object", "coverage", band.alias("band"))


def common_fields(profile: DataFrame, k: int = 50) -> DataFrame:
    """Paths that several objects have."""
    return profile.groupBy("path").agg(F.sort_array(F.collect_set("object")).alias("objects"), F.countDistinct("object").alias("n")).where("n > 1").orderBy(F.desc("n"), "path").limit(k)


def mixed_types(profile: DataFrame) -> DataFrame:
    kinds = F.filter(F.map_keys("types"), lambda t: t != "null")
    return profile.select(*KEY, F.size(kinds).alias("kinds")).where("kinds > 1")


def statistics_summary(profile: DataFrame) -> DataFrame:
    """Fields with numbers and fields with dates, per object and, under a null
    object, in all."""
    has = lambda *kinds: F.arrays_overlap(F.map_keys("types"), F.array(*map(F.lit, kinds)))
    return profile.rollup("object").agg(F.count_if(has("int", "float")).alias("numeric_fields"), F.count_if(has("date")).alias("temporal_fields"))


def material_types(types: Column, share: float = 0.02) -> Column:
    """Types with at least max(1, share) of the non-null values, sorted."""
    filled = F.map_filter(types, lambda t, n: t != "null")
    total = F.aggregate(F.map_values(filled), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.sort_array(F.map_keys(F.map_filter(filled, lambda t, n: n >= F.greatest(F.lit(1.0), total * share))))


def content_universe(counts: DataFrame, names: Sequence[str] = ("type", "category", "kind", "class", "genre", "segment"), k: int = 10) -> DataFrame:
    """The largest segments of type-like fields over all objects."""
    last = F.lower(F.regexp_extract("path", r"([^.\[\]]+)(\[\])?$", 1))
    return counts.where("value is not null").where(last.isin(*names)).groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value").limit(k)


def locale_dimensions(counts: DataFrame) -> DataFrame:
    """Locale, country and currency codes with their counts."""
    name = F.lower("path")
    kind = (
        F.when(F.col("value").rlike(r"^[a-z]{2}(_[A-Z]{2})?$") & name.rlike("lang|locale"), "locale")
        .when(F.col("value").rlike("^[A-Z]{2}$") & name.rlike("country|nation|region"), "country")
        .when(F.col("value").rlike("^[A-Z]{3}$") & name.rlike("curr"), "currency")
    )
    return counts.select(kind.alias("dimension"), "value", "n").where("dimension is not null").groupBy("dimension", "value").agg(F.sum("n").alias("n"))
