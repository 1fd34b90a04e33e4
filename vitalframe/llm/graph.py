"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, meet


def _contract(batches: Iterator[pa.RecordBatch], flush: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Union-find over what a task has seen: a forest of (node, least node)
    replaces its edges. Flushed now and then, so memory is bounded."""
    parent: dict = {}

    def root(x):
        at = x
        while (p := parent.get(at, at)) != at:
            at = p
        while (p := parent.get(x, x)) != at:
            parent[x], x = at, p
        return at

    def out():
        nodes = [x for x in parent if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([root(x) for x in nodes], pa.binary())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > flush:
            yield from out()
            parent.clear()
    if parent:
        yield from out()


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """``edges(u, v)`` of binary nodes -> ``(node, root)``, root the least node
    of the component, one row per node that has an edge. Every step deals by
    node; each result is written to the shared folder."""
    at = materialize(edges.select("u", "v").mapInArrow(_contract, "u binary, v binary").where("u != v").distinct(), "cc")
    for _ in range(most):
        both = at.union(at.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = meet(both, low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = meet(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).where("u != v").distinct()
        new = materialize(small, "cc")
        # The forest of stars no longer changes: each node hangs on its root alone.
        done = new.select("u").distinct().count() == new.count() and meet(new, new.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()
        at = new
        if done:
            break
    else:
        raise RuntimeError("components have not settled")
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).union(at.select("v", "v").distinct().toDF("node", "root"))
