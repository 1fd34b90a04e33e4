"""Run history: append-only Parquet tables, one partition per run."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift
from ..operators.runs import Past, Stored

TABLES = ("metrics", "profile", "categories", "meta")


class History:
    """Runs under ``root``: ``<table>/run=<tag>``. Protected tags are never
    deleted; letter case does not matter for them."""

    def __init__(self, spark: SparkSession, root: str, protected: Sequence[str] = ("baseline",)):
        self.spark, self.root, self.protected = spark, root.rstrip("/"), {p.lower() for p in protected}

    def _at(self, table: str, tag: str | None = None) -> str:
        return f"{self.root}/{table}" + (f"/run={tag}" if tag else "")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def save(self, tag: str, run_date: str, metrics: DataFrame, profile: DataFrame, categories: DataFrame, breached: Sequence[tuple[str, str, str]] = (), meta: dict[str, Any] | None = None) -> None:
        bad = self.spark.createDataFrame(list(breached), "metric string, object string, path string").distinct().withColumn("breached", F.lit(True))
        kept = metrics.join(F.broadcast(bad), ["metric", "object", "path"], "left").na.fill(False, ["breached"]).withColumns({"run_date": F.to_date(F.lit(run_date)), "tag": F.lit(tag)})
        kept.write.mode("overwrite").parquet(self._at("metrics", tag))
        profile.write.mode("overwrite").parquet(self._at("profile", tag))
        categories.withColumn("tag", F.lit(tag)).write.mode("overwrite").parquet(self._at("categories", tag))
        row = self.spark.createDataFrame([(run_date, json.dumps(meta or {}))], "run_date string, meta string")
        row.coalesce(1).write.mode("overwrite").parquet(self._at("meta", tag))

    def save_run(self, tag: str, run_date: str, stored: Stored, findings: Sequence[dict[str, Any]] = (), meta: dict[str, Any] | None = None) -> None:
        """Write a run's stored tables. Metrics that failed are marked, so that bands are not
        learned from them."""
        failed = [(f["kind"], f["object"], f["path"]) for f in findings if f["severity"] == "fail" and f["kind"] in drift.THRESHOLD_METRICS]
        self.save(tag, run_date, stored.metrics, stored.profile, stored.categories, failed, meta)

    def stored(self, tag: str) -> Stored:
        at = lambda table: self.spark.read.parquet(self._at(table, tag))
        return Stored(at("metrics").select("metric", "object", "path", "value"), at("profile"), at("categories").select("object", "path", "value", "n"))

    def past(self, mode: str = "previous", tag: str | None = None, run_date: str | None = None, window: int = drift.ROLLING["window"]) -> Past | None:
        """What a run (``tag``, ``run_date``) is compared with: ``previous``, ``baseline:<tag>`` or
        ``rolling`` (the last run, and bands over all runs before this one). None if
        there is nothing."""
        kind, _, wanted = mode.partition(":")
        if kind not in ("previous", "baseline", "rolling"):
            raise ValueError(f"unknown mode {mode}: previous, baseline:<tag> or rolling")
        runs = [(t, d) for t, d in self.runs() if t != tag]
        if kind == "baseline":
            found = [t for t, _ in runs if t.lower() == (wanted or "baseline").lower()]
            if not found:
                raise ValueError(f"no run {wanted or 'baseline'} in {self.root}")
            return Past(self.stored(found[0]), found[0], mode)
        runs = [t for t, d in runs if run_date is None or d <= run_date]
        if not runs:
            return None
        if kind == "previous":
            return Past(self.stored(runs[0]), runs[0], mode)
        every = lambda table: self.spark.read.option("mergeSchema", "true").parquet(*(self._at(table, t) for t in runs))
        return Past(self.stored(runs[0]), runs[0], mode, every("metrics"), runs[:window], every("categories"))

    def read(self, table: str, tag: str | None = None) -> DataFrame:
        df = self.spark.read.parquet(self._at(table))
        return df if tag is None else df.where(F.col("run").cast("string") == tag).drop("run")

    def runs(self) -> list[tuple[str, str]]:
        """(tag, date), newest first."""
        fs, at = self._fs(self._at("meta"))
        if not fs.exists(at):
            return []
        rows = self.read("meta").select(F.col("run").cast("string").alias("run"), "run_date").collect()  # one row per run
        return sorted(((r["run"], r["run_date"]) for r in rows), key=lambda x: (x[1], x[0]), reverse=True)

    def delete(self, tag: str) -> bool:
        if tag.lower() in self.protected:
            return False
        gone = False
        for table in TABLES:
            fs, at = self._fs(self._at(table, tag))
            gone |= bool(fs.delete(at, True))
        return gone

    def purge(self, keep_days: int, today: str) -> list[str]:
        from datetime import date, timedelta

        limit = (date.fromisoformat(today) - timedelta(days=keep_days)).isoformat()
        return [tag for tag, day in self.runs() if day < limit and self.delete(tag)]
