"""Source types by name; each gives named DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Dataset:
    """One object of a source; ``frame`` has typed columns or one VARIANT ``v``."""

    name: str
    frame: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)


Opener = Callable[[SparkSession, Mapping[str, Any]], list[Dataset]]
_openers: dict[str, Opener] = {}


def register(kind: str, opener: Opener) -> None:
    _openers[kind] = opener


def available() -> list[str]:
    _load()
    return sorted(_openers)


def open_source(spark: SparkSession, spec: Mapping[str, Any]) -> list[Dataset]:
    """``spec["type"]`` picks the opener; files are the default."""
    _load()
    kind = spec.get("type", "file")
    if kind not in _openers:
        raise ValueError(f"unknown source type {kind!r}; known: {', '.join(sorted(_openers))}")
    return _openers[kind](spark, spec)


def _load() -> None:
    from . import documents, files, rest, tables

    for kind, opener in (("file", files.open_files), ("table", tables.open_tables), ("jdbc", tables.open_jdbc), ("http", rest.open_http), ("mongodb", documents.open_mongodb)):
        _openers.setdefault(kind, opener)
