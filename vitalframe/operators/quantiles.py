"""Exact quantiles by narrowing ranges, without a buffer that grows with distinct values.

A quantile is an order statistic, or lies between two neighbours. Of each group, the range from
the least to the greatest value is cut into ``BUCKETS`` equal parts, whose rows are counted (a
small aggregate, combined before the shuffle); running sums over the parts tell in which of
them the wanted ranks lie; and only these are looked at further, until they hold one value or no
more than ``FEW`` rows, which are then put in order. Rows are never sorted or shuffled as a
whole. Parts are at least told apart by their least and greatest values, so it comes
to an end; three passes are usual.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, FEW = 4096, 10_000


def _part(x: Column, low: Column, high: Column) -> Column:
    """The part of [low, high] that x lies in; it never falls as x grows. Halves, as the
    width of a range may be beyond the largest number."""
    width = high / 2 - low / 2
    inside = F.least(F.floor((x / 2 - low / 2) / width * BUCKETS), F.lit(BUCKETS - 1))
    return F.when(width > 0, inside).otherwise((x > low).cast("long")).cast("int")


def exact(rows: DataFrame, keys: Sequence[str], points: Sequence[float]) -> DataFrame:
    """``keys`` and ``quantiles``: the values at ``points`` (0 to 1) of column ``x`` (double,
    not null, not NaN), each row counting ``w`` times; neighbours are interpolated as
    ``percentile`` does. A row per group, range and rank passes through the driver."""
    spark, keys = rows.sparkSession, list(keys)
    whole = rows.groupBy(*keys).agg(F.sum("w").alias("__n"), F.count("*").alias("__rows"), F.min("x").alias("__low"), F.max("x").alias("__high")).where("__n > 0").collect()
    kinds = [rows.schema[k] for k in keys]
    key_of = lambda r: tuple(r[k] for k in keys)
    total = {key_of(r): int(r["__n"]) for r in whole}
    wanted = {k: sorted({p for q in points for p in (int(q * (n - 1)), min(n - 1, int(q * (n - 1)) + 1))}) for k, n in total.items()}
    values: dict[tuple, dict[int, float]] = {k: {} for k in total}
    # Ranges still open: group, least and greatest value, rows of it, and what lies below.
    open_ = [(key_of(r), r["__low"], r["__high"], r["__rows"], 0, int(r["__n"])) for r in whole]
    final: list[tuple] = []
    table = T.StructType([*kinds, *(T.StructField(n, t) for n, t in (("__r", T.IntegerType()), ("__low", T.DoubleType()), ("__high", T.DoubleType()), ("__before", T.LongType())))])

    def inside(ranges: list[tuple]) -> DataFrame:
        few = F.broadcast(spark.createDataFrame([(*k, i, low, high, before) for i, (k, low, high, _, before, _) in enumerate(ranges)], table))  # ranges: two a point and group at most
        met = few.join(rows.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("x").between(F.col("__low"), F.col("__high"))])
        return met

    while open_:
        rest = []
        for r in open_:
            k, low, high, n, before, size = r
            if low == high:
                values[k] |= {p: low for p in wanted[k] if before <= p < before + size}
            elif n <= FEW:
                final.append(r)
            else:
                rest.append(r)
        open_ = []
        if rest:
            parts = inside(rest).groupBy("__r", _part(F.col("x"), F.col("__low"), F.col("__high")).alias("__b"))
            parts = parts.agg(F.sum("w").alias("n"), F.count("*").alias("rows"), F.min("x").alias("low"), F.max("x").alias("high"), F.first("__before").alias("__before"))
            below = F.coalesce(F.sum("n").over(Window.partitionBy("__r").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            parts = parts.withColumn("before", F.col("__before") + below)
            ranks = spark.createDataFrame([(i, wanted[r[0]]) for i, r in enumerate(rest)], "__r int, ranks array<long>")
            held = F.exists("ranks", lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))
            for r in parts.join(F.broadcast(ranks), "__r").where(held).collect():  # a part per rank at most
                open_.append((rest[r["__r"]][0], r["low"], r["high"], r["rows"], int(r["before"]), int(r["n"])))
    if final:
        upto = F.sum("n").over(Window.partitionBy("__r").orderBy("x"))
        each = inside(final).groupBy("__r", "__before", "x").agg(F.sum("w").alias("n")).withColumn("end", F.col("__before") + upto)
        ranks = spark.createDataFrame([(i, wanted[r[0]]) for i, r in enumerate(final)], "__r int, ranks array<long>")
        got = each.join(F.broadcast(ranks), "__r").select("__r", "x", F.filter("ranks", lambda p: (p >= F.col("end") - F.col("n")) & (p < F.col("end"))).alias("ranks")).where(F.size("ranks") > 0)
        for r in got.collect():  # a row per rank at most
            values[final[r["__r"]][0]] |= dict.fromkeys(r["ranks"], r["x"])
    out = []
    for k, n in total.items():
        line = []
        for q in points:
            at = q * (n - 1)
            low = int(at)
            a, b = values[k][low], values[k][min(n - 1, low + 1)]
            line.append(a if a == b or at == low else (low + 1 - at) * a + (at - low) * b)
        out.append((*k, line))
    return spark.createDataFrame(out, T.StructType([*kinds, T.StructField("quantiles", T.ArrayType(T.DoubleType()))]))
