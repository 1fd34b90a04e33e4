"""Comparisons: records by key, profiles by field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import normalised
from .profile import material_types


def leaves(df: DataFrame, skip: Sequence[str] = ()) -> list[tuple[str, Column]]:
    """Leaf paths and their text; of an array of objects the first object counts,
    and lists compare without order."""
    out: list[tuple[str, Column]] = []

    def walk(prefix: str, fields: list[T.StructField], get) -> None:
        for f in fields:
            path, c, kind = f"{prefix}{f.name}", get(f.name), f.dataType
            if path in skip:
                continue
            if isinstance(kind, T.StructType):
                walk(f"{path}.", kind.fields, lambda n, c=c: c[n])
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
                walk(f"{path}[].", kind.elementType.fields, lambda n, c=c: F.try_element_at(c, F.lit(1))[n])
            elif isinstance(kind, T.ArrayType):
                out.append((path, F.when(F.size(c) > 0, F.to_json(F.array_sort(F.transform(c, lambda x: x.cast("string")))))))
            else:
                out.append((path, normalised(c, kind)[0].cast("string")))

    walk("", df.schema.fields, lambda n: F.col(f"`{n}`"))
    return out


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``k`` (the key's parts, which stay apart and may be null) and the leaf texts; of
    repeated keys one row stays (the greatest leaves, so that reruns agree)."""
    k = F.struct(*(F.col(f"`{c}`").cast("string").alias(f"k{i}") for i, c in enumerate(keys)))
    fields = leaves(df, keys)
    pairs = F.array(*(F.struct(F.lit(p).alias("p"), v.alias("v")) for p, v in fields)) if fields else F.array().cast("array<struct<p:string,v:string>>")
    return df.select(k.alias("k"), pairs.alias("f")).groupBy("k").agg(F.max("f").alias("f"))


def record_changes(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key on one side only (``only_in_1``, ``only_in_2``) or per
    changed leaf: key, kind, field, old, new. A key of several parts is shown as a JSON
    list; a null part meets a null part alone."""
    x, y = _keyed(a, keys).select(F.col("k").alias("ka"), F.col("f").alias("fa")), _keyed(b, keys).select(F.col("k").alias("kb"), F.col("f").alias("fb"))
    # Parts are compared one by one, null-safely: Spark joins on each of them.
    same = [F.col(f"ka.k{i}").eqNullSafe(F.col(f"kb.k{i}")) for i in range(len(keys))]
    met = x.join(y, same, "full_outer")
    part = lambda i: F.col("k")[f"k{i}"]
    shown = part(0) if len(keys) == 1 else F.to_json(F.array(*(part(i) for i in range(len(keys)))))
    met = met.withColumn("k", F.coalesce("ka", "kb")).withColumn("k", shown)
    table = lambda f: F.map_from_entries(f)
    sided = F.when(F.col("fb").isNull(), "only_in_1").when(F.col("fa").isNull(), "only_in_2")
    alone = met.where(sided.isNotNull()).select("k", sided.alias("kind"), *(F.lit(None).cast("string").alias(c) for c in ("field", "old", "new")))
    both = met.where(sided.isNull() & ~F.col("fa").eqNullSafe(F.col("fb")))
    paths = F.array_union(F.transform("fa", lambda s: s["p"]), F.transform("fb", lambda s: s["p"]))
    each = both.select("k", table(F.col("fa")).alias("ma"), table(F.col("fb")).alias("mb"), F.explode(paths).alias("field")).select("k", "field", F.col("ma")[F.col("field")].alias("old"), F.col("mb")[F.col("field")].alias("new"))
    kind = F.when(F.col("old").isNull(), "null_to_value").when(F.col("new").isNull(), "value_to_null").otherwise("modified")
    return alone.unionByName(each.where(~F.col("old").eqNullSafe(F.col("new"))).select("k", kind.alias("kind"), "field", "old", "new"))


def record_summary(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Changes per field and kind."""
    return record_changes(a, b, keys).groupBy("field", "kind").agg(F.count("*").alias("n"))


def sampled_pair(a: DataFrame, b: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """The same n keys from both sides, so that sampling makes no orphans."""
    from .sampling import sample_order

    chosen = a.select(*keys).union(b.select(*keys)).distinct().orderBy(sample_order(seed, *keys), *keys).limit(n)
    return a.join(chosen, list(keys), "left_semi"), b.join(chosen, list(keys), "left_semi")


def profile_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer join of two profiles: status, coverage and types of each field."""
    facts = lambda p, s: p.select("object", "path", F.col("coverage").alias(f"{s}_coverage"), F.col("rows").alias(f"{s}_rows"), F.col("distinct").alias(f"{s}_distinct"), material_types(F.col("types")).alias(f"{s}_types"))
    met = facts(old, "old").join(facts(new, "new"), ["object", "path"], "full_outer")
    status = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").otherwise("common")
    changed = (status == "common") & (F.col("old_types") != F.col("new_types")) & (F.size("old_types") > 0) & (F.size("new_types") > 0)
    return met.withColumns({"status": status, "delta": F.col("new_coverage") - F.col("old_coverage"), "type_changed": changed})


def object_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Objects added, removed and common."""
    a, b = old.select("object").distinct().withColumn("a", F.lit(1)), new.select("object").distinct().withColumn("b", F.lit(1))
    return a.join(b, "object", "full_outer").select("object", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("common").alias("status"))


def deep_diff(old: DataFrame, new: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Divergence per common field: half types, 0.3 coverage, 0.2 cardinality.
    ``mapping`` renames objects of the old profile."""
    if mapping:
        pairs = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
        old = old.withColumn("object", F.coalesce(pairs[F.col("object")], F.col("object")))
    d = profile_diff(old, new).where("status = 'common'")
    union = F.size(F.array_union("old_types", "new_types"))
    types = F.when(union == 0, 0.0).otherwise(1 - F.size(F.array_intersect("old_types", "new_types")) / union)
    most = F.greatest("old_distinct", "new_distinct")
    cardinality = F.when(most == 0, 0.0).otherwise(F.abs(F.col("old_distinct") - F.col("new_distinct")) / most)
    return d.select("object", "path", (0.5 * types + 0.3 * F.abs("delta") / 100 + 0.2 * cardinality).alias("divergence"))


def value_overlap(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """One row: share of a's distinct values that b has, Jaccard, containment by row."""
    x = a.where(F.col(a_col).isNotNull()).groupBy(F.col(a_col).alias("v")).agg(F.count("*").alias("na"))
    y = b.where(F.col(b_col).isNotNull()).groupBy(F.col(b_col).alias("v")).agg(F.count("*").alias("nb"))
    m = x.join(y, "v", "full_outer")
    both = F.col("na").isNotNull() & F.col("nb").isNotNull()
    s = m.agg(F.count_if(both).alias("shared"), F.count("na").alias("a_distinct"), F.count("nb").alias("b_distinct"), F.count("*").alias("u"), F.sum(F.when(both, F.col("na"))).alias("hits"), F.sum("na").alias("total"))
    return s.select("shared", "a_distinct", "b_distinct", (F.col("shared") / F.col("u")).alias("jaccard"), (F.col("shared") / F.col("a_distinct")).alias("overlap"), (F.coalesce("hits", F.lit(0)) / F.col("total")).alias("contained"))
