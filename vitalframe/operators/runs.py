"""Drift of a run against runs stored before it.

A run leaves three tables behind (``Stored``): metrics, the profile of its fields, and the
value counts of category-like fields. Fields that hold personal data leave no values: no
dates, quantiles or sketch, and their values masked. All comparisons are joins of such tables,
whose size is that of fields, not of data:

* schema events, judged by how often a field was there lately and whether it is personal;
* thresholds against one earlier run (``previous`` or ``baseline:<tag>``);
* learned bands (``rolling``): of each series the last values that were no breach, clamped to
  what the metric can be, no narrower than its noise; thresholds where there are too few;
* new and vanished categories, with the values of the recent runs known;
* distribution shifts, of categories from counts, of numbers from stored quantiles.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import is_identifier
from ..functions.scores import psi_term, se_column
from . import compare, drift, profile

SKETCH = 128
#: Of at most so many values, numeric distributions know their noise.
NOISE_ROWS, NUMERIC_BINS = 20_000, 12
FINDING = (
    "kind string, metric string, object string, path string, severity string, old double, new double, delta double, direction string, z double, lower double, upper double, "
    "threshold string, scope string, message string"
)
COUNTED, PERCENT = ("row_count", "distinct"), ("coverage", "orphan_pct", "dqi", "health")
KEY = ["object", "path"]


@dataclass
class Stored:
    """What a run leaves behind: ``metrics`` (metric, object, path, value), ``profile``
    (see ``stored_profile``) and ``categories`` (object, path, value, n)."""

    metrics: DataFrame
    profile: DataFrame
    categories: DataFrame


@dataclass
class Past:
    """What a run is compared with. ``metrics``: those of all earlier runs (tag, run_date,
    metric, object, path, value, breached); ``recent``: tags of the last runs, newest first;
    ``categories``: tag, object, path, value of these."""

    reference: Stored | None = None
    tag: str | None = None
    mode: str = "previous"
    metrics: DataFrame | None = None
    recent: Sequence[str] = field(default_factory=list)
    categories: DataFrame | None = None

    @property
    def rolling(self) -> bool:
        return self.mode == "rolling" and self.metrics is not None


def stored_profile(counts: DataFrame, fields: DataFrame, personal: DataFrame, links: DataFrame) -> DataFrame:
    """The profile as it is kept: one row per field with ``masked`` (the kind of personal
    data, or null), ``skip`` (values say nothing about drift: keys, links, dates, personal data),
    ``numbers``, ``mean`` and ``quantiles`` (21) of numbers, and ``sketch``: the ``SKETCH`` least
    hashes of distinct values. ``personal``: object, path, masked; ``links``: object, path."""
    least = F.row_number().over(Window.partitionBy(*KEY).orderBy("h"))
    hashes = counts.where("value is not null").select(*KEY, F.xxhash64("value").alias("h"))
    # The least hashes of the parts of a field: the last of so many that are wanted bounds them all.
    parts = hashes.groupBy(*KEY, F.pmod("h", F.lit(8 * SKETCH)).alias("part")).agg(F.min("h").alias("h"))
    bound = parts.withColumn("i", least).where(F.col("i") == SKETCH).select(*KEY, F.col("h").alias("__most"))
    reached = hashes.join(F.broadcast(bound), KEY, "left").where("__most is null or h <= __most")  # one row per field
    sketch = reached.select(*KEY, "h").distinct().withColumn("i", least).where(F.col("i") <= SKETCH).groupBy(*KEY).agg(F.array_sort(F.collect_list("h")).alias("sketch"))
    numbers = profile.numeric(counts.where("number is not null"), KEY, F.col("number"), F.col("n")).select(*KEY, F.col("count").alias("numbers"), "mean", "quantiles")
    spark = fields.sparkSession
    names = [(r["path"],) for r in fields.select("path").distinct().collect() if is_identifier(r["path"])]  # one row per name
    ids = spark.createDataFrame(names, "path string").withColumn("__id", F.lit(True))
    out = fields.join(F.broadcast(personal), KEY, "left").join(F.broadcast(links.distinct().withColumn("__link", F.lit(True))), KEY, "left").join(F.broadcast(ids), "path", "left")  # rows per field
    out = out.join(numbers, KEY, "left").join(sketch, KEY, "left")
    known = F.col("masked").isNull()
    skip = F.col("__id").isNotNull() | F.col("__link").isNotNull() | ~known | F.map_contains_key("types", "date")
    cleared = {c: F.when(known, F.col(c)) for c in ("first_date", "last_date", "numbers", "mean", "quantiles", "sketch")}
    return out.withColumns({**cleared, "skip": skip}).drop("__id", "__link")


def kept_categories(counts: DataFrame, stored: DataFrame) -> DataFrame:
    """Value counts of category-like fields: few values, and none to be skipped."""
    like = stored.where("low_cardinality and not skip").select(*KEY)
    return counts.where("value is not null").join(F.broadcast(like), KEY).groupBy(*KEY, "value").agg(F.sum("n").alias("n"))  # rows per field


# ---------------------------------------------------------------- rules and messages


def bound(pairs: DataFrame, rules: drift.Rules, metric: str) -> DataFrame:
    """``object, path, params, scope``: for each pair the nearest rule of ``metric``, by
    field, object, dataset, built in."""
    spark = pairs.sparkSession
    rows = []
    for place, x in enumerate(rules.listed()):
        if x["metric"] == metric and isinstance(x["rule"], dict):
            params = {k: str(v) for k, v in x["rule"].items()}
            rows.append((x["object"], drift.glob_regex(x["object"]), x["path"], drift.glob_regex(x["path"]), x["scope"], drift.SCOPES.index(x["scope"]), place, params))
    table = spark.createDataFrame(rows, "r_object string, object_rx string, r_path string, path_rx string, scope string, level int, place int, params map<string,string>")
    return drift.nearest(pairs.select(*KEY).distinct(), table, ["params", "scope"])


def param(key: str, default: str) -> Column:
    return F.coalesce(F.col("params")[key], F.lit(default))


def render(template: Column, values: Mapping[str, Column]) -> Column:
    """A message template filled in; one that names anything else stays as it is."""
    out = template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return F.when(out.rlike(r"\{[^{}]*\}"), template).otherwise(out)


def shown(metric: Column, value: Column) -> Column:
    return F.when(metric.isin(*COUNTED), F.format_number(value, 0)).otherwise(F.concat(F.format_number(value, 1), F.lit("%")))


def _place() -> Column:
    return F.concat(F.when(F.col("object") == "", "dataset").otherwise(F.col("object")), F.when(F.col("path") == "", "").otherwise(F.concat(F.lit("."), F.col("path"))))


def as_findings(df: DataFrame, **cols: Column) -> DataFrame:
    """Columns of ``FINDING``; those that neither ``df`` nor ``cols`` has are null."""
    given = df.withColumns(cols) if cols else df
    parts = (x.split(" ") for x in FINDING.split(", "))
    return given.select(*((F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in parts))


# ---------------------------------------------------------------- schema


def sketched_renames(diff: DataFrame, old: DataFrame, new: DataFrame, least_shared: float = 0.5, most_gap: float = 10.0) -> DataFrame:
    """As ``drift.renames``, from stored sketches: the share of common values is that
    among the least hashes of both."""
    parent = F.when(F.col("path").contains("."), F.regexp_extract("path", r"^(.*)\.", 1)).otherwise("")
    side = lambda status, s, p: diff.where(F.col("status") == status).select("object", F.col("path"), F.col(f"{s}_coverage"), F.col(f"{s}_types").alias("types"), parent.alias("parent")).join(p.select(*KEY, F.col("sketch").alias(f"{s}_sketch")), KEY).withColumnRenamed("path", f"{s}_path")
    pairs = side("removed", "old", old).join(side("added", "new", new), ["object", "types", "parent"])
    pairs = pairs.withColumn("gap", F.abs(F.col("old_coverage") - F.col("new_coverage"))).where(F.col("gap") <= most_gap)
    joint = F.slice(F.array_sort(F.array_union("old_sketch", "new_sketch")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("old_sketch", "new_sketch"), joint))
    pairs = pairs.withColumn("shared", F.when(F.size(joint) > 0, both / F.size(joint)).otherwise(0.0)).where(F.col("shared") >= least_shared)
    order = (F.desc(F.col("shared") - F.col("gap") / 100), "old_path", "new_path")
    best = lambda s: F.row_number().over(Window.partitionBy("object", s).orderBy(*order)) == 1
    return pairs.withColumns({"a": best("old_path"), "b": best("new_path")}).where("a and b").select("object", "old_path", "new_path", "shared")


def seen_lately(past: Past, spark: SparkSession) -> DataFrame:
    """``object, path, seen``: in how many of the recent runs a field was."""
    if not past.rolling or not past.recent:
        return spark.createDataFrame([], "object string, path string, seen long")
    return past.metrics.where(F.col("metric") == "coverage").where(F.col("tag").isin(*past.recent)).groupBy(*KEY).agg(F.countDistinct("tag").alias("seen"))


def schema_events(current: DataFrame, reference: DataFrame, rules: drift.Rules, past: Past, renamed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings on objects and fields that came, went or changed type, and the fields
    (object, path) concerned. A lost field of which fewer than five rows were due, or that
    some of the recent runs lacked too, is only noted; so is one that came back. A
    personal field that comes in is a warning at least."""
    spark, window = current.sparkSession, len(past.recent) if past.rolling else 0
    objects = compare.object_diff(reference, current)
    o = objects.where("status != 'common'").withColumn("path", F.lit(""))
    o = o.join(bound(o, rules, "schema"), KEY).withColumn("kind", F.concat(F.lit("object_"), "status"))
    o = as_findings(
        o, metric=F.lit("schema"), severity=F.when(F.col("status") == "added", param("object_added", "info")).otherwise(param("object_removed", "fail")), threshold=F.col("kind"),
        message=F.when(F.col("status") == "added", F.format_string("Object %s is new.", "object")).otherwise(F.format_string("Object %s is not in this run.", "object")),
    )
    diff = compare.profile_diff(reference, current).join(objects.where("status = 'common'").select("object"), "object")
    renamed = sketched_renames(diff, reference, current) if renamed is None else renamed
    ends = renamed.select("object", F.explode(F.array("old_path", "new_path")).alias("path"))
    facts = lambda p, s, *c: p.select(*KEY, *(F.col(x).alias(f"{s}_{x}") for x in c))
    size = current.groupBy("object").agg(F.max("rows").alias("size"))
    d = diff.where("status != 'common' or type_changed").join(ends, KEY, "left_anti").join(size, "object")
    d = d.join(facts(reference, "was", "presence"), KEY, "left").join(facts(current, "is", "types", "masked"), KEY, "left").join(seen_lately(past, spark), KEY, "left")
    d = d.join(bound(d, rules, "schema"), KEY).na.fill(0, ["seen"])
    due = F.col("was_presence") / F.greatest(F.col("old_rows"), F.lit(1)) * F.col("size")
    rare, off = due < 5, F.lit(window > 0) & (F.col("seen") < window)
    fresh = F.array_except("new_types", "old_types")
    filled = F.aggregate(F.map_values(F.map_filter("is_types", lambda t, n: t != "null")), F.lit(0).cast("long"), lambda a, x: a + x)
    share = F.aggregate(F.transform(fresh, lambda t: F.coalesce(F.col("is_types")[t], F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + x) * 100.0 / F.greatest(filled, F.lit(1))
    gone, came = F.col("status") == "removed", F.col("status") == "added"
    added = param("field_added", "info")
    added = F.when(F.col("is_masked").isNotNull(), F.when(added.isin("warn", "fail"), added).otherwise("warn")).when(F.col("seen") > 0, "info").otherwise(added)
    kind = F.when(gone, "field_removed").when(came, "field_added").otherwise("type_changed")
    severity = F.when(gone, F.when(rare | off, "info").otherwise(param("field_removed", "fail"))).when(came, added).otherwise(param("type_changed", "fail"))
    why = F.when(rare, F.format_string(" Only %.1f rows of it were due.", due)).when(off, F.format_string(" It was in %d of the last %d runs.", "seen", F.lit(window))).otherwise("")
    told = F.when(F.col("is_masked").isNotNull(), F.format_string(" It holds personal data (%s).", "is_masked")).when(F.col("seen") > 0, F.format_string(" It was in %d of the last %d runs.", "seen", F.lit(window))).otherwise("")
    message = (
        F.when(gone, F.concat(F.format_string("Field %s.%s is gone (%.0f%% filled before).", "object", "path", "old_coverage"), why))
        .when(came, F.concat(F.format_string("Field %s.%s is new (%.0f%% filled).", "object", "path", "new_coverage"), told))
        .otherwise(F.format_string("%s.%s changed type from %s to %s; %.1f%% of its values have the new type.", "object", "path", F.array_join("old_types", ", "), F.array_join("new_types", ", "), share))
    )
    events = as_findings(
        d, kind=kind, metric=F.lit("schema"), severity=severity, threshold=kind, message=message,
        old=F.when(gone, F.col("old_coverage")), new=F.when(came, F.col("new_coverage")).when(~gone, share), delta=F.lit(None),
    )
    moved = renamed.withColumn("path", F.col("new_path"))
    moved = moved.join(bound(moved, rules, "schema"), KEY)
    moved = as_findings(
        moved, kind=F.lit("field_renamed"), metric=F.lit("schema"), severity=param("field_renamed", "warn"), threshold=F.lit("field_renamed"), new=F.col("shared"),
        message=F.format_string("%s.%s looks renamed to %s (%.0f%% of their values in common).", "object", "old_path", "new_path", F.col("shared") * 100), path=F.concat("old_path", F.lit(" -> "), "new_path"),
    )
    return o.unionByName(events).unionByName(moved), diff.where("status != 'common'").select(*KEY)


# ---------------------------------------------------------------- metrics


def threshold_findings(current: DataFrame, reference: DataFrame, rules: drift.Rules) -> DataFrame:
    """Metrics against one earlier run, each by its nearest rule; what is not ok."""
    t = drift.threshold_findings(current, reference, rules, templates=True).where("severity != 'ok'")
    m = F.col("metric")
    pct = F.when(F.col("old") != 0, F.format_string("%+.1f%%", F.col("delta") / F.abs("old") * 100)).otherwise(F.format_string("%+.2f pts", "delta"))
    values = {
        "object": F.when(F.col("object") == "", "dataset").otherwise(F.col("object")), "dot": F.when(F.col("path") == "", "").otherwise("."), "field": F.col("path"), "metric": F.replace(m, F.lit("_"), F.lit(" ")),
        "old": shown(m, F.col("old")), "baseline": shown(m, F.col("old")), "new": shown(m, F.col("new")), "delta": F.format_string("%+.2f", "delta"), "delta_pct": pct, "threshold": F.col("threshold"),
    }
    usual = F.when(F.col("direction") == "drop", "{object}{dot}{field}: {metric} fell from {old} to {new} ({delta_pct}).").otherwise("{object}{dot}{field}: {metric} rose from {old} to {new} ({delta_pct}).")
    return as_findings(t, kind=m, message=render(F.coalesce("template", usual), values))


def last_values(history: DataFrame, window: int, exclude_breaches: bool = True) -> DataFrame:
    """``metric, object, path, seen``: of each series the last ``window`` values, those that
    were a breach in their own run left out. At most ``window`` rows a series are gathered."""
    kept = history.where(~F.coalesce("breached", F.lit(False))) if exclude_breaches else history
    back = F.row_number().over(Window.partitionBy("metric", *KEY).orderBy(F.desc("run_date"), F.desc("tag")))
    return kept.withColumn("back", back).where(F.col("back") <= window).groupBy("metric", *KEY).agg(F.collect_list("value").alias("seen"))


def scored_by_bands(current: DataFrame, history: DataFrame, rules: drift.Rules) -> DataFrame:
    """Each threshold metric with the band learned from its series: ``median, sigma, lower, upper,
    z, n`` and ``severity`` (``cold`` with fewer than ``min_history`` values)."""
    cfg = rules.rolling
    sampled = current.where("metric = 'sampled'").select("object", F.col("value").alias("rows"))
    met = current.where(F.col("metric").isin(*drift.THRESHOLD_METRICS)).join(sampled, "object", "left").join(last_values(history, int(cfg["window"]), bool(cfg["exclude_breaches"])), ["metric", *KEY], "left")
    met = met.withColumn("seen", F.coalesce("seen", F.array().cast("array<double>")))
    m, ordered = F.col("metric"), F.array_sort("seen")
    middle = F.try_element_at(ordered, F.floor(F.size("seen") / 2).cast("int") + 1)
    floor = F.lit(float(cfg["abs_floor"]))
    floor = F.when(m.isin(*COUNTED), F.greatest(floor, F.lit(1.0))).when(m == "coverage", F.greatest(floor, F.coalesce(se_column(middle, F.coalesce("rows", F.lit(0))), F.lit(0.0)))).otherwise(floor)
    low, high = F.when(m.isin(*COUNTED, *PERCENT), F.lit(0.0)), F.when(m.isin(*PERCENT), F.lit(100.0))
    return drift.score_bands(met, float(cfg["k"]), floor, float(cfg["rel_floor"]), int(cfg["min_history"]), low, high)


def rolling_findings(current: DataFrame, history: DataFrame, reference: DataFrame | None, rules: drift.Rules) -> DataFrame:
    """Findings by learned bands. A series with too short a history is judged against the
    reference by its thresholds; rules that somebody set hold besides any band."""
    scored = scored_by_bands(current, history, rules)
    m = F.col("metric")
    k = f"{float(rules.rolling['k']):g}"
    out = as_findings(
        scored.where("severity in ('warn', 'fail')").drop("n"), kind=m, old=F.col("median"), new=F.col("value"), delta=F.col("value") - F.col("median"), direction=F.when(F.col("value") < F.col("median"), "drop").otherwise("increase"),
        scope=F.lit("rolling"), threshold=F.format_string(f"outside median +- {k} sigma and the range seen (%s to %s)", shown(m, F.col("lower")), shown(m, F.col("upper"))),
        message=F.format_string("%s: %s of %s is outside its usual %s to %s.", _place(), F.replace(m, F.lit("_"), F.lit(" ")), shown(m, F.col("value")), shown(m, F.col("lower")), shown(m, F.col("upper"))),
    )
    if reference is None:
        return out
    warm = scored.where("severity != 'cold'").select("metric", *KEY, F.lit(True).alias("warm"))
    fixed = threshold_findings(current, reference, rules).join(warm, ["metric", *KEY], "left").where("warm is null or scope != 'builtin'").drop("warm")
    return out.unionByName(fixed)


# ---------------------------------------------------------------- values


def _share_up_to(q: Column, x: Column, strictly: bool = False) -> Column:
    """Share of values <= x (or < x) by equidistant quantiles ``q``, ascending, interpolated.
    Levels that share a value form a jump."""
    below = F.size(F.filter(q, lambda v: v < x if strictly else v <= x))
    step = 1.0 / (F.size(q) - 1)
    v0, v1 = F.try_element_at(q, below), F.try_element_at(q, below + 1)
    between = (below - 1) * step + step * (x - v0) / (v1 - v0)
    return F.when(below == 0, 0.0).when(below >= F.size(q), 1.0).otherwise(between)


def quantile_psi(old: Column, new: Column, bins: int = 10) -> Column:
    """PSI of two arrays of equidistant quantiles: over the old deciles, with a bin below and
    one above them; equal edges fall together. 0 without two edges."""
    places = F.filter(old, lambda v, i: i % F.greatest(F.floor((F.size(old) - 1) / bins), F.lit(1)) == 0)
    edges = F.array_sort(F.array_distinct(places))

    def shares(q: Column) -> Column:
        marks = F.transform(edges, lambda x, i: F.when(i == 0, _share_up_to(q, x, True)).otherwise(_share_up_to(q, x)))
        marks = F.concat(F.array(F.lit(0.0)), marks, F.array(F.lit(1.0)))
        return F.transform(F.slice(marks, 2, F.size(marks) - 1), lambda x, i: F.greatest(F.lit(0.0), x - F.element_at(marks, i + 1)))

    terms = F.zip_with(shares(old), shares(new), psi_term)
    return F.when(F.size(edges) < 2, 0.0).otherwise(F.round(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), 4))


def value_findings(current: Stored, reference: Stored, rules: drift.Rules, past: Past) -> DataFrame:
    """Category and distribution drift of fields in both runs that say something about it:
    no keys, links, dates or personal data, filled in ``min_rows`` rows and in 1 % of
    the present run's, with distinct values in fewer than half of them."""
    p, q = current.profile, reference.profile
    enough = lambda x: x.where("not skip").where(F.col("filled") >= rules.min_rows)
    size = F.least("rows", "old_rows") >= rules.min_rows
    now = enough(p).where("coverage >= 1").where(F.col("distinct") < 0.5 * F.col("filled")).select(*KEY, "rows", "low_cardinality", "numbers", "mean", "quantiles")
    then = enough(q).select(*KEY, F.col("rows").alias("old_rows"), F.col("low_cardinality").alias("old_low"), F.col("numbers").alias("old_numbers"), F.col("mean").alias("old_mean"), F.col("quantiles").alias("old_quantiles"))
    both = now.join(then, KEY).where(size)
    either = F.broadcast(both.where("low_cardinality and old_low").select(*KEY))  # rows per field
    changes = drift.category_changes(reference.categories.join(either, KEY), current.categories.join(either, KEY))
    changes = changes.withColumns({"total": F.sum("new_n").over(Window.partitionBy(*KEY)), "before": F.sum("old_n").over(Window.partitionBy(*KEY))}).where("total > 0 and before > 0")
    named = lambda df: F.array_join(F.slice(F.array_sort(F.collect_list("value")), 1, 5), ", ")
    new = changes.where("status = 'new'")
    if past.rolling and past.categories is not None:
        new = new.join(past.categories.where(F.col("tag").isin(*past.recent)).select(*KEY, "value").distinct(), [*KEY, "value"], "left_anti")
    rare = F.bool_and((F.col("new_n") <= 2) & (F.col("new_share") < 0.01) & (F.col("total") < 1000))
    new = new.groupBy(*KEY).agg(rare.alias("rare"), named(new).alias("values"), F.count("*").alias("new"))
    gone = changes.where("status = 'vanished'").where((F.col("old_share") >= 0.005) & (F.col("old_share") * F.col("total") >= 5))
    gone = gone.groupBy(*KEY).agg(named(gone).alias("values"), F.count("*").alias("old"))
    cat = lambda df: df.join(bound(df, rules, "categories"), KEY)
    new = as_findings(cat(new), kind=F.lit("categories_new"), metric=F.lit("categories"), severity=F.when(F.col("rare"), "info").otherwise(param("new", "warn")), threshold=F.lit("new"), message=F.format_string("%s.%s has new values: %s.", *KEY, "values"))
    gone = as_findings(cat(gone), kind=F.lit("categories_vanished"), metric=F.lit("categories"), severity=param("vanished", "warn"), threshold=F.lit("vanished"), message=F.format_string("%s.%s lost values: %s.", *KEY, "values"))
    top = F.max_by(F.format_string("'%s' %.1f%% -> %.1f%%", "value", F.col("old_share") * 100, F.col("new_share") * 100), F.struct(F.abs("shift"), "value"))
    of_categories = drift.categorical_psi(changes).join(changes.groupBy(*KEY).agg(top.alias("told")), KEY).select(*KEY, "psi", "noise", "told")
    inner = lambda x: F.least(F.col(x), F.lit(NOISE_ROWS))
    median = lambda x: F.try_element_at(F.col(x), F.floor(F.size(x) / 2).cast("int") + 1)
    of_numbers = both.where("not (low_cardinality and old_low)").where("quantiles is not null and old_quantiles is not null").select(
        *KEY, quantile_psi(F.col("old_quantiles"), F.col("quantiles")).alias("psi"), ((NUMERIC_BINS - 1) * (1 / inner("old_numbers") + 1 / inner("numbers"))).alias("noise"),
        F.format_string("mean %.4g -> %.4g, median %.4g -> %.4g", "old_mean", "mean", median("old_quantiles"), median("quantiles")).alias("told"),
    )
    psi = of_categories.unionByName(of_numbers)
    psi = psi.join(bound(psi, rules, "distribution"), KEY)
    warn, fail = param("psi_warn", "0.1").cast("double"), param("psi_fail", "0.25").cast("double")
    severity = F.when(F.col("psi") <= drift.NOISE_SIGMAS * F.col("noise"), "ok").when(F.col("psi") >= fail, "fail").when(F.col("psi") >= warn, "warn").otherwise("ok")
    shift = as_findings(
        psi.withColumn("severity", severity).where("severity != 'ok'"), kind=F.lit("distribution"), metric=F.lit("distribution"), new=F.col("psi"),
        threshold=F.format_string("PSI >= %s warn, >= %s fail, above %.3f", param("psi_warn", "0.1"), param("psi_fail", "0.25"), drift.NOISE_SIGMAS * F.col("noise")),
        message=F.format_string("%s.%s has another distribution (PSI %.2f): %s.", *KEY, "psi", "told"),
    )
    return shift.unionByName(new).unionByName(gone)


def metric_findings(metrics: DataFrame, past: Past, rules: drift.Rules | None = None) -> DataFrame:
    """Findings on metrics alone, in the mode of ``past``."""
    rules = rules or drift.Rules()
    reference = past.reference.metrics if past.reference else None
    if past.rolling:
        return rolling_findings(metrics, past.metrics, reference, rules)
    return metrics.sparkSession.createDataFrame([], FINDING) if reference is None else threshold_findings(metrics, reference, rules)


def findings(current: Stored, past: Past, rules: drift.Rules | None = None, renamed: DataFrame | None = None) -> DataFrame:
    """All findings of a run against ``past`` (columns of ``FINDING``), none where there is
    nothing to compare with. ``renamed``: pairs found in raw values, in place of sketches."""
    rules = rules or drift.Rules()
    parts: list[DataFrame] = []
    metrics = current.metrics
    if past.reference is not None:
        events, changed = schema_events(current.profile, past.reference.profile, rules, past, renamed)
        metrics = metrics.join(changed, KEY, "left_anti")
        parts += [events, value_findings(current, past.reference, rules, past)]
    out = metric_findings(metrics, past, rules)
    for x in parts:
        out = out.unionByName(x)
    return out
