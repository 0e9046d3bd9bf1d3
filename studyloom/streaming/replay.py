"""The replay of offline writes as a stream with keyed state: of each row its version, kept between micro-batches.

A row's writes of one micro-batch are decided as one batch of the replay (``operators.sync``), in a single pass that holds
one write: of those older than the server clock only the first that isn't older than the row is applied, so the earliest
found so far is held back, and all others are decided as they come. The row's version moves to the server clock; writes
of later micro-batches meet that version, after a restart from the checkpoint, too.

Writes bring the version that their row has in storage (a join of the stream with the table). A timer drops the state of
rows without a write for ``idle_seconds``, as the table has their version by then. It counts the times at which writes
came in (``received_at``), never the clients': a watermark over these would drop late writes unanswered, and every write is answered.
Without ``idle_seconds`` state stays.
"""

from __future__ import annotations

import tempfile
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

#: How far writes may come in out of the order of their ``received_at``.
OUT_OF_ORDER = "1 minute"
RESULT = "key long, op_id long, status string"
#: State stores that hold typed state and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a temporary one only under a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and known.isDefined():
        base = known.get()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='studyloom-')}"
    return base.rstrip("/")


class Versions(StatefulProcessor):
    """Decides the writes of a row; holds its version in microseconds."""

    def __init__(self, clock: int | None, idle_seconds: int | None):
        self.clock, self.idle = clock, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.version = handle.getValueState("version", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        clock = self.clock if self.clock is not None else time.time_ns() // 1000
        moved = self.version.get()[0] if self.version.exists() else None
        held, applied, last = None, False, 0
        for batch in rows:
            out = []
            last = max(last, int(batch["received"].max()))
            for op, at, stored in zip(batch["op_id"].tolist(), batch["at"].tolist(), batch["version"].tolist(), strict=True):
                if stored is None or stored != stored:
                    out.append((op, "skipped"))
                elif at < (stored if moved is None else max(moved, stored)):
                    out.append((op, "conflict"))
                elif at >= clock:
                    applied = True
                    out.append((op, "applied"))
                elif held is None or (at, op) < held:
                    if held is not None:
                        out.append((held[1], "conflict"))
                    held = (at, op)
                else:
                    out.append((op, "conflict"))
            if out:
                yield pd.DataFrame({"key": key[0], "op_id": [op for op, _ in out], "status": [s for _, s in out]})
        if held is not None:
            yield pd.DataFrame({"key": [key[0]], "op_id": [held[1]], "status": ["applied"]})
        if applied or held is not None:
            self.version.update((clock,))
        if self.idle is not None and self.version.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(last // 1000 + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.version.clear()
        return iter([])

    def close(self) -> None:
        pass


def decided(ops: DataFrame, server_clock: str | None = None, idle_seconds: int | None = None) -> DataFrame:
    """``key``, ``op_id`` and ``status`` of a stream of writes (``key``, ``op_id``, ``client_ts``, ``version``: that of the stored row,
    null without one; with ``idle_seconds`` also ``received_at``, a timestamp). ``server_clock``: a fixed time in UTC, or
    none for the executor's."""
    spark = ops.sparkSession
    micros = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(c).cast("timestamp_ntz"))
    rows, mode, received = ops, "None", F.lit(0).cast("long")
    if idle_seconds is not None:
        rows, mode, received = ops.withWatermark("received_at", OUT_OF_ORDER), "EventTime", F.unix_micros("received_at")
    rows = rows.select("key", "op_id", micros("client_ts").alias("at"), micros("version").cast("double").alias("version"), received.alias("received"), *(["received_at"] if idle_seconds is not None else []))
    clock = None if server_clock is None else spark.sql(f"SELECT timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01', TIMESTAMP_NTZ '{server_clock}')").first()[0]
    return rows.groupBy("key").transformWithStateInPandas(Versions(clock, idle_seconds), RESULT, "Append", mode)


def replay_stream(ops: DataFrame, folder: str, server_clock: str | None = None, idle_seconds: int | None = None) -> DataFrame:
    """Runs :func:`decided` to the end of what is there and reads all results. A second run with the same ``folder`` goes on where
    the first one ended."""
    spark = ops.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    query = decided(ops, server_clock, idle_seconds).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    spark.conf.set(key, before)
    query.awaitTermination()
    return spark.read.schema(RESULT).parquet(f"{folder}/out")
