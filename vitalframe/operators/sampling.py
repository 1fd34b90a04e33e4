"""Row selection: head, tail, reproducible samples of exact size, blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_order(seed: int | str, *keys: str) -> Column:
    """A repeatable random order: md5 of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def reservoir(df: DataFrame, k: int, keys: Sequence[str], seed: int | str = 42) -> DataFrame:
    """Exactly k rows (or all), uniform, the same on every run: a top-k by hash."""
    return df.orderBy(sample_order(seed, *keys), *keys).limit(k)


def head(df: DataFrame, k: int) -> DataFrame:
    return df.limit(k)


def tail(df: DataFrame, k: int, order: Sequence[str]) -> DataFrame:
    """The last k rows in an explicit order."""
    return df.orderBy(*(F.desc(c) for c in order)).limit(k)


def blocks(df: DataFrame, share: float, k: int | None = None, seed: int = 42) -> DataFrame:
    """A share of the rows, and a limit if asked for."""
    out = df.sample(False, share, seed)
    return out if k is None else out.limit(k)


def select(df: DataFrame, size: int, strategy: str = "reservoir", keys: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """By strategy name; size 0 is a full scan."""
    if size == 0:
        return df
    if strategy == "head":
        return head(df, size)
    if strategy == "tail":
        return tail(df, size, keys)
    if strategy == "reservoir":
        return reservoir(df, size, keys, seed) if keys else df.orderBy(F.rand(seed)).limit(size)
    raise ValueError(f"unknown strategy {strategy!r}")
