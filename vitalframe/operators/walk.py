"""The document walk: every record becomes (path, type, value) nodes.

``flat_counts`` serves the scalar columns of a typed table: values are counted per
column in their own types first, and only distinct values are turned into text
and given a type. ``typed_nodes`` compiles a whole typed schema, nested or not, to
one projection and one explode. ``variant_nodes`` walks VARIANT values in one pass,
for data whose records differ in shape; a missing key gives no node, an
explicit null one of type ``null``.

A node's ``present`` is 1 once per record and path, and ``empty`` 1 if the record
holds no filled value there; inside arrays only the first element of a record
carries them. Types and values count per element. Arrays are walked whole, to
``MAX_ARRAY_DEPTH`` levels, unless ``array_items`` bounds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import infer_type, is_empty, normalised, string_type
from ..session import settle

MAX_DEPTH, MAX_ARRAY_DEPTH, LONG_VALUE = 10, 3, 512
SKIPPED_KEYS = ("_id",)
_NODE = "struct<path:string,type:string,present:int,empty:int,value:string,number:double>"
COUNTS = "object string, path string, type string, value string, number double, present long, empty long, n long"


def _scalar(kind: T.DataType) -> bool:
    return not isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def short_value(s: Column) -> Column:
    """A text as a grouping key: long ones by their beginning and digest."""
    return F.when(F.length(s) > LONG_VALUE, F.concat(F.substring(s, 1, 64), F.lit("...#"), F.md5(s))).otherwise(s)


def _node(path: Column, c: Column, kind: T.DataType, present: Column, empty: Column) -> Column:
    value, kind = normalised(c, kind)
    number = value.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    text = value.cast("string") if _scalar(kind) else F.lit(None).cast("string")
    if isinstance(kind, T.StringType):
        text = short_value(text)
    return F.struct(path.alias("path"), infer_type(value, kind).alias("type"), present.cast("int").alias("present"), empty.cast("int").alias("empty"), text.alias("value"), number.alias("number"))


def _blank(c: Column, kind: T.DataType) -> Column:
    return is_empty(*normalised(c, kind))


def _walk(prefix: str, fields: list[T.StructField], get, depth: int, max_depth: int, items: int | None) -> list[Column]:
    """Arrays of nodes for the fields of an object reached by ``get(name)``."""
    out: list[Column] = []
    for f in fields:
        if f.name in SKIPPED_KEYS or depth > max_depth:
            continue
        path, c = f"{prefix}{f.name}", get(f.name)
        out.append(F.array(_node(F.lit(path), c, f.dataType, F.lit(1), _blank(c, f.dataType))))
        out += _below(path, c, f.dataType, depth, max_depth, items)
    return out


def _below(path: str, c: Column, kind: T.DataType, depth: int, max_depth: int, items: int | None) -> list[Column]:
    if isinstance(kind, T.StructType):
        inner = _walk(f"{path}.", kind.fields, lambda n: c[n], depth + 1, max_depth, items)
        return [F.when(c.isNotNull(), x).otherwise(F.array().cast(f"array<{_NODE}>")) for x in inner]
    return _many(path, F.filter(F.array(c), lambda x: x.isNotNull()), kind, depth, max_depth, 0, items)


def _field(name: str):
    return lambda x: x[name]


def _flagged(path: str, xs: Column, kind: T.DataType) -> Column:
    """Nodes for all values ``xs`` that one record holds at ``path``."""
    first = lambda i: (i == 0).cast("int")
    filled = F.exists(xs, lambda x: ~_blank(x, kind))
    return F.transform(xs, lambda x, i: _node(F.lit(path), x, kind, first(i), first(i) * (~filled).cast("int")))


def _many(path: str, xs: Column, kind: T.DataType, depth: int, max_depth: int, arrays: int, items: int | None) -> list[Column]:
    """What lies below the non-null values ``xs`` of one record, whose own nodes
    are made already."""
    if depth > max_depth:
        return []
    out: list[Column] = []
    there = lambda ys: F.filter(ys, lambda y: y.isNotNull())
    if isinstance(kind, T.ArrayType) and arrays < MAX_ARRAY_DEPTH:
        inner = F.flatten(xs if items is None else F.transform(xs, lambda x: F.slice(x, 1, items)))
        if not isinstance(kind.elementType, T.StructType):  # objects in arrays count under their fields only
            out.append(_flagged(f"{path}[]", inner, kind.elementType))
        out += _many(f"{path}[]", there(inner), kind.elementType, depth, max_depth, arrays + 1, items)
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            if f.name not in SKIPPED_KEYS and depth + 1 <= max_depth:
                inner = F.transform(xs, _field(f.name))
                out.append(_flagged(f"{path}.{f.name}", inner, f.dataType))
                out += _many(f"{path}.{f.name}", there(inner), f.dataType, depth + 1, max_depth, arrays, items)
    elif isinstance(kind, T.MapType):  # each key is a path; nested values are not walked further
        pairs = F.flatten(F.transform(xs, F.map_entries))
        keys = F.transform(pairs, lambda p: p["key"].cast("string"))
        first = lambda p, i: (F.array_position(keys, p["key"].cast("string")) == i + 1).cast("int")
        filled = lambda p: F.exists(pairs, lambda q: (q["key"] == p["key"]) & ~_blank(q["value"], kind.valueType))
        nodes = F.transform(pairs, lambda p, i: _node(F.concat(F.lit(f"{path}."), p["key"].cast("string")), p["value"], kind.valueType, first(p, i), first(p, i) * (~filled(p)).cast("int")))
        out.append(F.filter(nodes, lambda n: ~n["path"].isin(*(f"{path}.{k}" for k in SKIPPED_KEYS))))
    return out


def typed_nodes(df: DataFrame, obj: str, max_depth: int = MAX_DEPTH, array_items: int | None = None) -> DataFrame:
    """``object, path, type, present, empty, value, number`` for every record."""
    arrays = _walk("", df.schema.fields, lambda n: F.col(f"`{n}`"), 0, max_depth, array_items)
    if not arrays:
        return df.sparkSession.createDataFrame([], "object string, path string, type string, present int, empty int, value string, number double")
    return df.select(F.explode(F.concat(*arrays)).alias("n")).select(F.lit(obj).alias("object"), "n.*")


def _slot(c: Column, kind: T.DataType) -> tuple[str, Column]:
    """Where a scalar is counted: as text, whole number, real number or time."""
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return "d", c.cast("double")
    if isinstance(kind, T.IntegralType):
        return "l", c.cast("long")
    if isinstance(kind, T.TimestampType):
        return "t", c
    if isinstance(kind, T.StringType):
        return "s", short_value(c)
    return "s", normalised(c, kind)[0].cast("string")


def flat_counts(tables: dict[str, DataFrame]) -> DataFrame | None:
    """Value counts of all top-level scalar columns of typed tables: one scan of
    each table and one shuffle, combined on the map side, keyed by a column's
    number and its value as it is stored. Text forms, types and emptiness are
    worked out for distinct values only."""
    kinds: list[tuple[str, str, T.DataType]] = []
    out = None
    blank = {"s": F.lit(None).cast("string"), "l": F.lit(None).cast("long"), "d": F.lit(None).cast("double"), "t": F.lit(None).cast("timestamp")}
    for obj, df in tables.items():
        cells = []
        for f in df.schema.fields:
            if _scalar(f.dataType) and not isinstance(f.dataType, (T.VariantType, T.NullType)) and f.name not in SKIPPED_KEYS:
                slot, c = _slot(F.col(f"`{f.name}`"), f.dataType)
                cells.append(F.struct(F.lit(len(kinds)).alias("f"), *((c if k == slot else x).alias(k) for k, x in blank.items())))
                kinds.append((obj, f.name, f.dataType))
        if cells:
            one = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
            out = one if out is None else out.unionByName(one)
    if out is None:
        return None
    d = F.when(~F.isnan("d") & (F.abs("d") < float("inf")), F.col("d"))
    stamp = normalised(F.col("t"), T.TimestampType())[0]
    value = F.coalesce("s", F.col("l").cast("string"), d.cast("string"), stamp)
    fixed = {i: "bool" if isinstance(k, T.BooleanType) else "int" if isinstance(k, T.IntegralType) else "date" if isinstance(k, T.TimestampType) else "float" for i, (_, _, k) in enumerate(kinds) if _slot(F.lit(None), k)[0] != "s" or isinstance(k, T.BooleanType)}
    of = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("f") + 1)
    label = of([fixed.get(i, "") for i in range(len(kinds))])
    counted = out.groupBy("f", "s", "l", "d", "t").agg(F.count("*").alias("n"))
    typed = counted.select("f", value.alias("value"), F.coalesce(F.col("l").cast("double"), d).alias("number"), "n")
    kind = F.when(F.col("value").isNull(), "null").when(label != "", label).otherwise(string_type(F.col("value")))
    empty = F.when(F.col("value").isNull() | (F.col("value") == ""), F.col("n")).otherwise(0)
    return typed.select(of([o for o, _, _ in kinds]).alias("object"), of([p for _, p, _ in kinds]).alias("path"), kind.alias("type"), "value", "number", F.col("n").alias("present"), empty.cast("long").alias("empty"), "n")


_LABEL_RULES = (("VOID", "null"), ("BOOLEAN", "bool"), ("BIGINT", "int"), ("DOUBLE", "float"), ("FLOAT", "float"), ("OBJECT", "object"), ("ARRAY", "array"))


def variant_type(v: Column) -> Column:
    """Type label of a VARIANT value: whole decimals beyond 64 bits are ints."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    out = F.when(v.isNull(), "null")
    for start, label in _LABEL_RULES:
        out = out.when(kind.startswith(start), label)
    big = kind.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(F.try_variant_get(v, "$", "double")) >= float(2**63))
    return out.when(big, "int").when(kind.startswith("DECIMAL"), "float").otherwise(string_type(text))


def _opened(rows: DataFrame, array_items: int | None) -> DataFrame:
    """Each row, and what an ``open`` one holds; rows are made and kept in one pass."""
    twice = rows.select("rid", "path", "arrays", "value", "type", F.explode(F.when(F.col("open"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("below"))
    inner = twice.sparkSession.tvf.variant_explode_outer(F.when(F.col("below"), F.col("value")).outer())
    e = twice.lateralJoin(inner.select("pos", "key", F.col("value").alias("item")))
    item = F.col("item").isNotNull() & (F.col("key").isNull() | ~F.col("key").isin(*SKIPPED_KEYS))
    if array_items is not None:
        item &= F.col("key").isNotNull() | (F.col("pos") < array_items)
    prefix = F.when(F.col("path") == "", "").otherwise(F.concat("path", F.lit(".")))
    path = F.when(F.col("key").isNull(), F.concat("path", F.lit("[]"))).otherwise(F.concat(prefix, F.col("key")))
    arrays = F.col("arrays") + F.col("key").isNull().cast("int")
    e = e.where(~F.col("below") | item)
    pick = lambda new, old: F.when(F.col("below"), new).otherwise(F.col(old)).alias(old)
    e = e.select("rid", "below", pick(path, "path"), pick(arrays, "arrays"), pick(F.col("item"), "value"), "type")
    e = e.withColumn("type", F.when(F.col("below"), variant_type(F.col("value"))).otherwise(F.col("type")))
    return e.select("rid", "path", "arrays", "value", "type", (F.col("below") & F.col("type").isin("object", "array") & (F.col("arrays") < MAX_ARRAY_DEPTH)).alias("open"))


def variant_nodes(df: DataFrame, obj: str, column: str = "v", max_depth: int = MAX_DEPTH, array_items: int | None = None) -> DataFrame:
    """Nodes of a VARIANT column. ``df`` is read once, at any depth: every level passes
    on the rows it has and adds what lies below the newest, all in one stage. Nodes are
    then a table in the checkpoint folder, as those inside arrays are counted by record.
    """
    nodes = df.select(F.monotonically_increasing_id().alias("rid"), F.lit("").alias("path"), F.lit(0).alias("arrays"), F.col(column).alias("value"), F.lit("").alias("type"), F.lit(True).alias("open"))
    for _ in range(max_depth + 1):
        nodes = _opened(nodes, array_items)
    nodes = nodes.where("type <> ''")  # all but the records themselves
    text = F.when(F.col("type").isin("object", "array", "null"), None).otherwise(F.try_variant_get("value", "$", "string"))
    number = F.when(F.col("type").isin("int", "float"), F.try_variant_get("value", "$", "double"))
    blank = F.to_json("value").isin("null", '""', "[]", "{}")
    # Elements of arrays of objects count under their fields only.
    kept = nodes.where(~(F.col("path").endswith("[]") & (F.col("type") == "object")))
    flat = settle(kept.select("rid", "path", "type", blank.cast("int").alias("blank"), text.alias("value"), number.alias("number")))
    inside = F.col("path").contains("[]")
    outer = flat.where(~inside).select(F.lit(obj).alias("object"), "path", "type", F.lit(1).alias("present"), F.col("blank").alias("empty"), "value", "number")
    per_record = flat.where(inside).groupBy("rid", "path", "type", "value", "number").agg(F.count("*").alias("n"), F.min("blank").alias("blank"))
    # Presence once per record: sums over (record, path) first.
    once = per_record.groupBy("rid", "path").agg(F.min("blank").alias("empty"), F.collect_list(F.struct("type", "value", "number", "n")).alias("xs"))
    spread = once.select("path", "empty", F.posexplode("xs").alias("i", "x")).select("path", "empty", "i", "x.*", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("k"))
    first = ((F.col("i") == 0) & (F.col("k") == 1)).cast("int")
    inner = spread.select(F.lit(obj).alias("object"), "path", "type", first.alias("present"), (first * F.col("empty")).alias("empty"), "value", "number")
    return outer.unionByName(inner)
