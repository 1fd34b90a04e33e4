"""Document stores through Spark's connector, with pushed-down filters."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession

from ..operators.filters import predicate
from .registry import Dataset


def parse_spec(spec: str) -> tuple[str, dict, str | None]:
    """``collection|{query} -> label``."""
    body, arrow, label = spec.partition(" -> ")
    name, bar, query = body.partition("|")
    return name.strip(), json.loads(query) if bar and query.strip() else {}, label.strip() if arrow else None


def open_mongodb(spark: SparkSession, spec: Mapping[str, Any]) -> list[Dataset]:
    """Collections by spec; needs the ``mongodb`` data source on the class path.
    Conditions become column predicates, which the source pushes down."""
    out = []
    for s in spec["objects"]:
        name, query, label = parse_spec(s)
        if name.startswith("system."):
            continue
        df = spark.read.format("mongodb").options(**{"connection.uri": spec["uri"], "database": spec["database"], "collection": name}).load()
        df = df.where(predicate(query, df.schema)) if query else df
        out.append(Dataset(label or name, df.drop("_id"), {"spec": s, "filter": query}))
    return out
