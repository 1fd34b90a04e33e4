"""Session settings the engine relies on."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What keyed state of streams is kept in.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build(master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName("vitalframe")
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.variant.allowDuplicateKeys": "true",  # the last of equal keys wins
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
    }
    return b.config(map=defaults | conf).getOrCreate()


_settled: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``, deleted at exit."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="vitalframe-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/settled-{uuid.uuid4().hex}"
    _settled.append((spark, path))
    return path


def settle(df: DataFrame) -> DataFrame:
    """Write a table to ``spark.checkpoint.dir`` and read it back: what is built on it is
    planned without what led to it, and outlives the executors that worked it out. Under a
    local master without that setting, a temporary folder serves."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _drop_settled() -> None:
    for spark, path in _settled:
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended: nothing is left to ask
            return
