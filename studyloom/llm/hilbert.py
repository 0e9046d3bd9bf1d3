"""Sharding by Hilbert-curve order.

Several metadata dimensions are quantised to ``bits`` bits each, at cuts that leave about equally many rows between them:
sizes as they are, names by the order of their bytes after what all of them begin with. So a code range is a range of the
real column. Rows are sorted by their index on the Hilbert curve through that grid and the order is cut into shards of
equal row counts. Neighbours on the curve are near in every dimension, so a shard covers a small box and its minima and
maxima prune files for filters on any of them.

Among equal curve indexes rows are ordered by their text's hash, so copies lie side by side. Law ``rows``: shard sizes
differ by at most one row. Whole rows are shuffled once, by ranges of the order, and written twice: in curve order, where
every row's place is counted, and as shard files, where a task writes the few shards its range reaches.

Defined results: null values of a dimension are code zero; null texts count no bytes and the CRC of no bytes; repeated
rows and rows without an id each have a place, which travels with the row; fewer rows than shards leave the last shards
empty; an empty table writes none; extra columns travel with the row, whatever their names.
"""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BITS = 6
LAW = "rows"


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the curve of integer points (rows) of any dimension: undo the excess rotations from the highest bit
    down, then Gray-decode, all points at once."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[n - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | (x[i] >> b & 1)
    return index


def name_number(name: Column, skip: int) -> Column:
    """Seven bytes of a name after the first ``skip``, as a number in the names' order."""
    some = F.hex(F.substring(F.encode(name, "UTF-8"), skip + 1, 7))
    return F.conv(F.rpad(some, 14, "0"), 16, 10).cast("long")


def dimensions(rows: DataFrame, names: list[str], numbers: list[str], bits: int = BITS) -> tuple[list[Column], list[list[int]]]:
    """A number for each column and the cuts of its codes: at most ``2**bits - 1`` each, by two aggregates of one row."""
    ends = [f(F.encode(F.col(c), "UTF-8")) for c in names for f in (F.min, F.max)]
    got = [bytes(x or b"") for x in rows.agg(*ends).first()] if ends else []
    skips = [len(os.path.commonprefix(got[i : i + 2])) for i in range(0, len(got), 2)]
    columns = [name_number(F.col(c), n) for c, n in zip(names, skips, strict=True)] + [F.col(c).cast("long") for c in numbers]
    at = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(*(F.percentile_approx(c, at, 10_000) for c in columns)).first()
    return columns, [sorted(x or []) for x in cuts]  # a value of many rows has many cuts, so codes fill the grid


def in_curve_order(rows: DataFrame, columns: list[Column], cuts: list[list[int]], order: list[str], shards: int, bits: int = BITS) -> DataFrame:
    """The rows with ``curve`` (index), ``shard`` and ``slot`` (place in the shard). ``order``: columns that break ties.
    One range shuffle; a count for each partition is all that is brought into one order."""
    if len(columns) * bits > 62:
        raise ValueError("too many bits for one index")

    @F.pandas_udf("long")
    def curve(*values: pd.Series) -> pd.Series:
        codes = [np.searchsorted(np.array(cut, np.int64), v.to_numpy(), side="right") for cut, v in zip(cuts, values, strict=True)]
        return pd.Series(hilbert_index(np.stack(codes, axis=1), bits))

    least = F.lit(-(1 << 63))  # below every cut
    ranged = rows.withColumn("curve", curve(*(F.coalesce(c, least) for c in columns))).repartitionByRange("curve", *order).sortWithinPartitions("curve", *order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()), "curve-order")
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", before.alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_rank", F.col("_before") + at)
    # The first (all mod shards) shards hold one row more.
    ranked = ranked.withColumn("_least", F.expr(f"_all div {shards}")).withColumn("_more", F.expr(f"_all % {shards}"))
    wide = F.col("_more") * (F.col("_least") + 1)
    in_wide = F.col("_rank") < wide
    shard = F.when(in_wide, F.expr("_rank div (_least + 1)")).otherwise(F.col("_more") + F.expr("(_rank - _more * (_least + 1)) div greatest(_least, 1)"))
    slot = F.when(in_wide, F.expr("_rank % (_least + 1)")).otherwise(F.expr("(_rank - _more * (_least + 1)) % greatest(_least, 1)"))
    return ranked.select("*", shard.cast("int").alias("shard"), slot.alias("slot")).drop("_at", "_part", "_before", "_all", "_rank", "_least", "_more")


def shard_documents(documents: DataFrame, shards: int = 40, doc_id: str = "doc_id", text: str = "text", names: tuple[str, ...] = ("lang", "source"), bits: int = BITS) -> DataFrame:
    """Every document as one column ``row`` with its ``curve``, ``shard`` and ``slot``."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    rows = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"),
        F.col(doc_id).alias("_id"),
        size.alias("_size"),
        F.xxhash64(text).alias("_hash"),
        *(F.col(n).cast("string").alias(f"_name{i}") for i, n in enumerate(names)),
    )
    columns, cuts = dimensions(rows, [f"_name{i}" for i in range(len(names))], ["_size"], bits)
    return in_curve_order(rows, columns, cuts, ["_hash", "_id"], shards, bits).select("row", "curve", "shard", "slot")


def write_shards(placed: DataFrame, path: str) -> DataFrame:
    """Write the rows of :func:`shard_documents` as a folder for each shard, in slot order, and return the table as read.
    No shuffle: rows come in curve order, so a task holds few shards, and a large shard is several tasks' files."""
    placed.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return placed.sparkSession.read.schema(placed.schema).parquet(path)


def shard_ranges(stored: DataFrame, columns: list[str]) -> DataFrame:
    """Minimum and maximum of ``columns`` of the rows for each shard: what a reader prunes files by."""
    return stored.groupBy("shard").agg(F.count("*").alias("n"), *(f(F.col("row")[c]).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("max", F.max))))
