"""Catalog tables, queries and JDBC, with one grammar of object specs:
``table``, ``table|condition -> label`` and ``query:SELECT ... -> label``."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .registry import Dataset

_SELECT = re.compile(r"^\s*(select|with)\b", re.IGNORECASE)


def parse_spec(spec: str) -> dict[str, str | None]:
    body, arrow, label = spec.partition(" -> ")
    if body.strip().lower().startswith("query:"):
        sql = body.strip()[6:].strip().rstrip(";")
        if not _SELECT.match(sql) or ";" in sql:
            raise ValueError("a query must be one SELECT")
        return {"query": sql, "table": None, "where": None, "label": label.strip() if arrow else None}
    table, bar, where = body.partition("|")
    return {"query": None, "table": table.strip(), "where": where.strip() if bar else None, "label": label.strip() if arrow else None}


def open_tables(spark: SparkSession, spec: Mapping[str, Any]) -> list[Dataset]:
    """``objects``: specs over the catalog; all tables if none are named."""
    specs = list(spec.get("objects") or (t.name for t in spark.catalog.listTables(spec.get("database"))))
    out = []
    for s in specs:
        p = parse_spec(s)
        df = spark.sql(p["query"]) if p["query"] else spark.table(p["table"])
        df = df.where(p["where"]) if p["where"] else df
        if spec.get("sample_percent"):
            df = df.sample(float(spec["sample_percent"]) / 100, seed=int(spec.get("seed", 42)))
        out.append(Dataset(p["label"] or p["table"] or f"query_{len(out) + 1}", df, {"spec": s}))
    return out


def open_jdbc(spark: SparkSession, spec: Mapping[str, Any]) -> list[Dataset]:
    """The same specs over a JDBC url; filters are pushed to the database."""

    def read(p: dict) -> DataFrame:
        r = spark.read.format("jdbc").options(url=spec["url"], **spec.get("options", {}))
        return (r.option("query", p["query"]) if p["query"] else r.option("dbtable", p["table"])).load()

    out = []
    for s in spec["objects"]:
        p = parse_spec(s)
        df = read(p)
        out.append(Dataset(p["label"] or p["table"] or f"query_{len(out) + 1}", df.where(p["where"]) if p["where"] else df, {"spec": s}))
    return out


def counts(objects: list[Dataset]) -> dict[str, int]:
    return {o.name: o.frame.count() for o in objects}
