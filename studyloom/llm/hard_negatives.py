"""Hard negatives by norm-bucketed search.

Vectors are quantised to integers and written in the order of their norms. A task reads its part of that order in buckets
of ``BUCKET`` rows, longest first. For a block of anchors (at most ``ANCHORS`` rows, sent to all tasks) it looks for the
best rows of every window: a positive window takes rows of the anchor's label, a negative window rows of other labels with
a score between two limits. By Cauchy and Schwarz no row of a bucket scores above anchor norm times the bucket's largest
norm, so a bucket is passed over for the windows whose lower limit or running kth score is higher; the least norm that any
window can use is pushed down to the scan. Scores are exact integers: float64 products where no sum can pass 2**53, whole
Python numbers otherwise.

A further block of anchors is another pass over the vectors; no pass holds more than a block in the driver and nothing is
sent that grows with the rows.

Defined results: rows with a null id, null label, null vector, or a null or infinite component take no part; a vector shorter than
the longest counts as filled with zeros; rows with one id are one row, the least by label and vector; equal scores go by
the smaller id; components and scores beyond 64 bits count as the largest value; an anchor without positives, and a
positive without negatives, give no row; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lean, written

SCALE, POSITIVES, NEGATIVES = 256, 5, 5
#: A negative scores at least so many hundredths of its positive.
LOWER_PERCENT = 80
BUCKET, ANCHORS, BLOCK_BYTES = 2048, 8192, 32 << 20
#: Anchors that are multiplied with a bucket at once.
SLICE = 128
_EXACT, _LONG = float(1 << 53), (1 << 63) - 1


def quantised(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v, norm2): the rows that take part, written by falling norm. norm2 is a double."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(whole)
    least = F.lit(float(-(1 << 63)))
    most = F.lit(float(1 << 63))
    quantise = F.transform("x", lambda x: F.floor(F.greatest(least, F.least(most, x * F.lit(float(scale))))))
    rows = rows.select("id", "label", quantise.alias("v"))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ordered = rows.withColumn("norm2", norm2).repartitionByRange(F.desc("norm2"), F.col("id")).sortWithinPartitions(F.desc("norm2"), "id")
    return written(ordered, "vectors")


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as rows of ``dims`` places, filled with zeros."""
    n = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if (n == dims).all():
        return flat.reshape(len(column), dims)
    out = np.zeros((len(column), dims), np.int64)
    out[np.arange(dims)[None, :] < n[:, None]] = flat
    return out


class Windows:
    """What is looked for: for each window its anchor's place in the block and its limits. Holds the best ``k`` rows found."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
        self.anchor, self.low, self.high, self.k = anchor, low, high, k
        self.score = np.zeros((len(anchor), k), low.dtype)
        self.id = np.zeros((len(anchor), k), np.int64)
        self.n = np.zeros(len(anchor), np.int64)
        #: Rows below can't enter: the lower limit, or the kth score once there are k.
        self.floor = low.copy()

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Take rows into the windows ``at``; only these are sorted anew."""
        if not len(at):
            return
        own = np.unique(at)
        x, y = np.nonzero(np.arange(self.k)[None, :] < self.n[own][:, None])
        at, score, ids = np.concatenate([own[x], at]), np.concatenate([self.score[own[x], y], score]), np.concatenate([self.id[own[x], y], ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < self.k
        self.score[at[best], rank[best]], self.id[at[best], rank[best]] = score[best], ids[best]
        self.n[own] = np.minimum(np.bincount(np.searchsorted(own, at)), self.k)
        full = own[self.n[own] == self.k]
        self.floor[full] = np.maximum(self.low[full], self.score[full, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.nonzero(np.arange(self.k)[None, :] < self.n[:, None])
        return x, self.score[x, y], self.id[x, y]


def reachable(norms2: np.ndarray, floor: np.ndarray, longest2: float) -> np.ndarray:
    """Windows whose floor a row of squared norm ``longest2`` can reach (with room for rounding)."""
    most = np.sqrt(norms2) * np.sqrt(longest2) * (1 + 1e-9)
    return most >= floor.astype(float)


def search(block: dict[str, np.ndarray], windows: Windows, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, norm2: np.ndarray, same: bool) -> None:
    """Take one bucket into the windows. ``same``: rows of the anchor's label but the anchor itself, else those of other labels."""
    if not len(ids):
        return
    open_ = np.flatnonzero(reachable(block["norm2"][windows.anchor], windows.floor, float(norm2.max())))
    exact = windows.low.dtype == np.int64
    rows = v.astype(float) if exact else v.astype(object)
    anchors = np.unique(windows.anchor[open_])
    for i in range(0, len(anchors), SLICE):
        part = anchors[i : i + SLICE]
        own = open_[(windows.anchor[open_] >= part[0]) & (windows.anchor[open_] <= part[-1])]
        scores = block["v"][part].astype(rows.dtype) @ rows.T
        fits = block["label"][part][:, None] == labels[None, :]
        fits = fits & (block["id"][part][:, None] != ids[None, :]) if same else ~fits
        place = np.searchsorted(part, windows.anchor[own])
        # Windows of an anchor share its scores; few of these pass the floors after the first bucket.
        for j in range(0, len(own), SLICE):
            w, at = own[j : j + SLICE], place[j : j + SLICE]
            found = scores[at].astype(windows.low.dtype)
            hit = fits[at] & (found >= windows.floor[w][:, None]) & (found <= windows.high[w][:, None])
            some = np.flatnonzero(hit.any(axis=1))
            w, found, hit = w[some], found[some], hit[some]
            if len(some) and hit.shape[1] > windows.k:
                # Of one bucket only rows from its own kth score on can enter.
                kth = np.partition(np.where(hit, found, windows.low[w][:, None] - 1), -windows.k, axis=1)[:, -windows.k]
                hit &= found >= kth[:, None]
            x, y = np.nonzero(hit)
            windows.add(w[x], found[x, y], ids[y])


def _pass(rows: DataFrame, block: dict[str, np.ndarray], bounds: dict[str, np.ndarray], k: int, same: bool, dims: int) -> DataFrame:
    """(window, score, id) of the best ``k`` rows of every window."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast((block, bounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, limits = sent.value
        windows = Windows(limits["anchor"], limits["low"], limits["high"], k)
        for batch in batches:
            for i in range(0, batch.num_rows, BUCKET):
                part = batch.slice(i, BUCKET)
                ids, labels, norm2 = (part.column(c).to_numpy() for c in ("id", "label", "norm2"))
                search(own, windows, ids, labels, matrix(part.column("v"), dims), norm2, same)
        at, score, ids = windows.found()
        score = np.clip(score, -_LONG - 1, _LONG).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(score), pa.array(ids, pa.int64())], names=["window", "score", "id"])

    # No window can use a shorter row, so these aren't read.
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(bounds["low"].astype(float) > 0, bounds["low"].astype(float) ** 2 / block["norm2"][bounds["anchor"]], 0)
    shortest = float(np.nan_to_num(need, nan=0.0, posinf=0.0).min(initial=np.inf)) * (1 - 1e-6)
    found = rows.where(F.col("norm2") >= shortest).mapInArrow(lean(run), "window long, score long, id long")
    place = F.row_number().over(Window.partitionBy("window").orderBy(F.desc("score"), "id"))
    best = written(found.withColumn("place", place).where(F.col("place") <= k), "window-rows")
    sent.unpersist()
    return best


def _block(rows: DataFrame, dims: int) -> dict[str, np.ndarray]:
    got = rows.select("id", "label", "norm2", "v").orderBy("id").toArrow().combine_chunks()
    columns = {c: got.column(c).to_numpy() for c in ("id", "label", "norm2")}
    lists = got.column("v").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    return columns | {"v": matrix(lists, dims)}


def mine(vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, lower_percent: int = LOWER_PERCENT) -> DataFrame:
    """For each anchor (rows where ``is_anchor`` holds over the column ``id``) and each of its best ``positives`` rows of its label, the best
    ``negatives`` rows of other labels whose score is between ``lower_percent`` hundredths of the positive's and the positive's.
    Labels are integers."""
    rows = quantised(vectors, vec_id, vector, label, scale)
    dims, longest2 = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max("norm2"), F.lit(0.0))).first()
    size = max(1, min(ANCHORS, BLOCK_BYTES // (8 * max(1, dims))))
    # Blocks of anchors: every block has about ``size`` of them, by the hash of their ids.
    anchors = rows.where(is_anchor)
    blocks = -(-anchors.count() // size)
    schema = "anchor_id long, positive_id long, positive_rank int, positive_score long, negative_id long, negative_score long, rank int"
    out = vectors.sparkSession.createDataFrame([], schema)
    for b in range(blocks):
        block = _block(anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b), dims)
        n = len(block["id"])
        if not n:
            continue
        exact = float(np.sqrt(block["norm2"].max()) * np.sqrt(longest2)) < _EXACT / 2
        kind, least, most = (np.int64, -(1 << 62), _LONG) if exact else (object, -(1 << 200), 1 << 200)
        everything = {"anchor": np.arange(n), "low": np.array([least] * n, kind), "high": np.array([most] * n, kind)}
        best = _pass(rows, block, everything, positives, True, dims).toArrow()
        at, score, ids, place = (best.column(c).to_numpy() for c in ("window", "score", "id", "place"))
        order = np.lexsort((place, at))
        at, score, ids, place = at[order], score[order], ids[order], place[order]
        low = np.array([-(-lower_percent * x // 100) for x in score.tolist()], kind)
        found = _pass(rows, block, {"anchor": at, "low": low, "high": score.astype(kind)}, negatives, False, dims)
        named = vectors.sparkSession.createDataFrame(pa.table({"window": np.arange(len(at)), "anchor_id": block["id"][at], "positive_id": ids, "positive_rank": place.astype(np.int32), "positive_score": score}))
        joined = found.withColumnRenamed("score", "negative_score").withColumnRenamed("id", "negative_id").join(F.broadcast(named), "window")
        out = out.unionByName(joined.withColumn("rank", F.col("place").cast("int")).select(out.columns))
    return out
