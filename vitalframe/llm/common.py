"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder of its own; on a
    cluster the setting is required.
    """
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="vitalframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut
    and later stages survive the loss of the executors that computed it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    # What led here is garbage now. Collecting it early lets Spark delete the shuffle
    # files and broadcasts behind it, and keeps the driver small over many tables.
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def meet(a: DataFrame, b: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two sides that grow with the input: always by merge, whose skewed
    partitions Spark can split, never by a broadcast that only a small input allows."""
    return a.join(b.hint("merge"), on, how)


@contextmanager
def scratch() -> Iterator[list[tuple[SparkSession, str]]]:
    """Collects the tables that are materialized inside, for ``drop``."""
    global _written
    outer, _written = _written, []
    try:
        yield _written
    finally:
        outer += _written
        _written = outer


def drop(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete materialized tables that nothing will read again."""
    for spark, path in list(tables):
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if (spark, path) in _written:
            _written.remove((spark, path))


@atexit.register
def _drop_written() -> None:
    try:
        drop(_written)
    except Exception:  # the session has ended: nothing is left to ask
        return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, mod ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % m


def arrow_map(
    df: DataFrame,
    fn: Callable[[list[dict]], pa.Table | pa.RecordBatch] | Callable,
    schema: T.StructType | str,
) -> DataFrame:
    """``mapInArrow`` with ``fn(batch) -> RecordBatch`` (one batch at a time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield fn(piece)

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece stays near ``max_bytes`` (one row at least)."""
    rows = batch.num_rows
    if rows == 0:
        return
    step = max(1, min(rows, int(rows * max_bytes / max(1, batch.nbytes))))
    for at in range(0, rows, step):
        yield batch.slice(at, step)
