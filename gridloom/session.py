"""Session settings and the shared scratch folder."""
from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_used: list[str] = []
_dry: ContextVar[bool] = ContextVar("dry", default=False)

SETTINGS = {
    "spark.sql.caseSensitive": "true",                      # `Amount` and `amount` are two columns
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}


def build_session(app: str = "gridloom", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.ui.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession) -> str:
    """The folder for tables an operator writes between two steps.

    A cluster names a shared folder in spark.checkpoint.dir. Only a local session without one gets a temporary folder;
    a cluster session without one is refused, because a machine-local folder is gone with its machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="gridloom-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, suffix: str = "") -> str:
    """A new path in the shared folder; `release_scratch` deletes what this session put there."""
    path = f"{scratch_folder(spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}{suffix}"
    _used.append(path)
    return path


def release_scratch(spark: SparkSession) -> int:
    """Delete the scratch tables of this session, once the results that read them are written. Returns how many."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    removed = 0
    while _used:
        path = jvm.org.apache.hadoop.fs.Path(_used.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed


@contextmanager
def nothing_written():
    """Inside, `written` hands its table on as it is. For trial runs on tables without rows."""
    token = _dry.set(True)
    try:
        yield
    finally:
        _dry.reset(token)


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back.

    Cuts the lineage where later steps must all see the same rows in the same places, survives lost executors, and
    gives the optimizer the table's real size, so it broadcasts the table only when that is small."""
    if _dry.get():
        return df
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def setting(spark: SparkSession, name: str, default: int) -> int:
    return int(spark.conf.get(f"spark.gridloom.{name}", str(default)))
