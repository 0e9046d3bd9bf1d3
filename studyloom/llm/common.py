"""Shared helpers of the corpus operators: the shared folder, written tables, and Arrow batches of texts."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

#: Texts are handled in slices of about so many bytes, so that a task's memory follows this and its longest text.
SLICE_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Where none is set, a temporary one is made, but only for
    a local master: on a cluster every executor would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='studyloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_MADE: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage and fixes the rows for all later reads."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    if _MADE:
        _MADE[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that is shuffled, never broadcast. For tables that grow with the input: Spark takes a written
    table's compressed files, and the rows that went into a Python task or an explode, for the size, so one of gigabytes may
    seem to fit into the driver."""
    return df.hint("merge")


@contextmanager
def passing(spark: SparkSession, path: str | None = None) -> Iterator[None]:
    """Tables written inside, and the one at ``path``, go when the block ends; what is needed later is written elsewhere
    before that."""
    _MADE.append([path] if path else [])
    try:
        yield
    finally:
        for path in _MADE.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name`` with underscores until no column has it (Spark's names don't depend on case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(spark: SparkSession) -> None:
    """Arrow batches of whole texts hold few rows, so that executors' memory doesn't follow the default of 10,000. A
    setting that the session already has differently stays."""
    for key, usual, now in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(SLICE_BYTES))):
        with suppress(Exception):  # a version may not know the second
            if usual is None or spark.conf.get(key) == usual:
                spark.conf.set(key, now)


def lean(run: Callable) -> Callable:
    """A task's function that gives its memory back to the system when it ends; workers outlive their tasks."""

    def leaned(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return leaned


def raw_bytes(column: pa.Array) -> pa.Array:
    """A text column as UTF-8 bytes without copying; nulls stay."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        return column.cast(pa.large_binary())
    return column.cast(pa.binary())


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices whose ``column`` holds about ``limit`` bytes (a longer text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)
