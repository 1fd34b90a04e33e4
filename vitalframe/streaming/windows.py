"""Streaming profile: each event-time window is a run of metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.drift import score_bands
from ..session import STATE_STORE, scratch


def windowed_profile(stream: DataFrame, time_col: str, fields: Sequence[str], width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Row counts and coverage per tumbling (or sliding) window; rows later than
    ``late`` behind the watermark are left out by Spark."""
    w = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias(f) for f in fields]
    agg = stream.withWatermark(time_col, late).groupBy(w.alias("w")).agg(F.count("*").alias("rows"), *filled)
    metrics = F.array(
        F.struct(F.lit("row_count").alias("metric"), F.lit("").alias("path"), F.col("rows").cast("double").alias("value")),
        *(F.struct(F.lit("coverage").alias("metric"), F.lit(f).alias("path"), (F.col(f) / F.col("rows") * 100).alias("value")) for f in fields),
    )
    return agg.select(F.col("w.start").alias("window_start"), F.explode(metrics).alias("m")).select("window_start", "m.*")


def sessions(stream: DataFrame, time_col: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Events per session of a key."""
    agg = stream.withWatermark(time_col, late).groupBy(key, F.session_window(time_col, gap).alias("w")).agg(F.count("*").alias("events"))
    return agg.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def feed(metrics: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand finished windows to ``sink(df, batch_id)``, once each if the sink
    overwrites by batch id."""
    return metrics.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _LastValues(StatefulProcessor):
    """The last ``window`` values of a series; each point goes out with those before it."""

    def __init__(self, window: int) -> None:
        self.window = window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seen array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = list(self.last.get()[0]) if self.last.exists() else []
        points = pd.concat(list(rows)).sort_values("window_start", kind="stable")
        before = []
        for value in points["value"]:
            before.append(list(seen))
            if not pd.isna(value):
                seen = [*seen, float(value)][-self.window :]
        self.last.update((seen,))
        yield pd.DataFrame({"metric": key[0], "path": key[1], "window_start": points["window_start"].to_numpy(), "value": points["value"].to_numpy(), "seen": before})

    def close(self) -> None:
        pass


def learned_bands(metrics: DataFrame, window: int = 14, k: float = 3.0, abs_floor: float = 0.0, rel_floor: float = 0.05) -> DataFrame:
    """Each finished window of ``windowed_profile`` against the band of up to ``window``
    windows before it in its series, as ``drift.rolling_bands`` has it for a table of them.
    The state of a series is its last values and no more. Windows are finished in order of
    time, and those of one batch are taken in that order. Null values pass through and are
    not learned from. Such state needs RocksDB as the session's state store: it is set where
    the session has another."""
    metrics.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = "metric string, path string, window_start timestamp, value double, seen array<double>"
    rows = metrics.groupBy("metric", "path").transformWithStateInPandas(_LastValues(window), out, "append", "none")
    return score_bands(rows, k, abs_floor, rel_floor)


def finished(metrics: DataFrame) -> DataFrame:
    """All that a stream yields from what is there now, as a table."""
    at = scratch(metrics.sparkSession)
    q = metrics.writeStream.outputMode("append").format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return metrics.sparkSession.read.schema(metrics.schema).parquet(f"{at}/rows")
