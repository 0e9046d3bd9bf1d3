"""Session and table helpers shared by all queries."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def ensure_worker_path(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed.

    On a cluster the package is installed or sent with ``--py-files``; then nothing changes here.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of ``sf_dir``, read by Spark's own reader."""
    ensure_worker_path(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the folder that all executors share (spark.checkpoint.dir) and read it again, so that what made it
    runs once. Only a local master may go without that setting."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='studyloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of one task of a shuffle that is dealt by :func:`dealt`.
TASK_ROWS = 500_000


def dealt(rows: DataFrame, table_rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` shuffled by ``keys`` into so many tasks that the rows of ``table_rows``, a table as it was read (its files tell how many it
    has), make at most about ``TASK_ROWS`` a task: a task's memory doesn't follow the input. Small tables keep the session's shuffle
    partitions."""
    n = table_rows.count() // TASK_ROWS + 1
    return rows.repartition(n, *keys) if n > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(*keys)


def build_session(app: str = "studyloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the queries are written for (UTC, AQE with skew handling)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_worker_path(spark)
    return spark
