"""SimHash near-duplicate classes by pivot distance tables.

Every distinct fingerprint has a table row of its Hamming distances to fixed reference fingerprints (pivots). Two
fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate, so a larger coordinate
difference discards a pair and only survivors are compared bit by bit.

Pairs are looked for inside buckets: of ``pieces`` equal parts of the 64 bits, two fingerprints within ``radius``
bits agree on all but ``radius`` parts, so each choice of agreeing parts is one bucket key. A bucket of more than
``bucket_limit`` distinct fingerprints is not compared in one task: there every fingerprint is sent to itself and to
its neighbours at one bit (outside the agreeing parts), and fingerprints that meet there are linked to the smallest of
them, which finds exactly the pairs within two bits. No pair list of a group is ever made.

Defined results: null, empty and wordless texts have fingerprint zero and are linked like others; texts below the
shingle length are one shingle; equal ids on several rows are one node; an empty table gives an empty result; the classes
are three columns, a filtered table keeps all of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, raw_bytes, slices, written

SHINGLE, RADIUS, PIECES, PIVOTS, BUCKET_LIMIT = 3, 2, 4, 16, 256

_SPLIT = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_SHIFTS = np.arange(63, -1, -1, dtype=np.uint64)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: the same n pseudo-random 64-bit values everywhere."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}") for i in range(n)], np.uint64)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    words = text.translate(_SPLIT).split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    digest = xxhash.xxh64_intdigest
    return [digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def fingerprint_of(text: bytes, size: int = SHINGLE) -> int:
    """Bit b is one where it is set in over half of the shingle hashes, repeats included."""
    ones, n = np.zeros(64, np.int64), 0
    hashes = shingle_hashes(text, size)
    for i in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[i : i + (1 << 16)], ">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(part)
    bits = (2 * ones > n).astype(np.uint64)
    return int((bits << _SHIFTS).sum(dtype=np.uint64))


def with_fingerprint(documents: DataFrame, text: str = "text", size: int = SHINGLE, out: str = "fp", keep: list[str] | None = None) -> DataFrame:
    """The documents (their columns ``keep``, or all) with the fingerprint as a signed 64-bit ``out``."""
    keep = [c for c in (documents.columns if keep is None else keep) if c != out]
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            fps = np.array([fingerprint_of(x or b"", size) for x in raw_bytes(batch.column(text)).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(fps.view(np.int64))], names=[*keep, out])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), schema)


def _masks(pieces: int, radius: int) -> list[int]:
    """Bit masks of every choice of pieces - radius parts."""
    edges = [64 * i // pieces for i in range(pieces + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(pieces)]
    return [sum(c) for c in combinations(parts, pieces - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _bucket(group: np.ndarray, radius: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket that connect the same fingerprints as all its pairs within the radius: every fingerprint
    to the first one it is linked to. Rows are sorted by the first pivot distance, so only a window is compared."""
    coordinates = np.bitwise_count(group[:, None] ^ table[None, :]).astype(np.int8)
    order = np.argsort(coordinates[:, 0], kind="stable")
    group, coordinates = group[order], coordinates[order]
    stop = np.searchsorted(coordinates[:, 0], coordinates[:, 0] + radius, side="right")
    left, right = [], []
    for i in range(len(group) - 1):
        near = np.arange(i + 1, stop[i])
        near = near[np.abs(coordinates[near] - coordinates[i]).max(axis=1) <= radius] if len(near) else near
        near = near[np.bitwise_count(group[near] ^ group[i]) <= radius]
        left.append(np.full(len(near), group[i]))
        right.append(group[near])
    return (np.concatenate(left), np.concatenate(right)) if left else (group[:0], group[:0])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, as links to the smallest member."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(names))
    x, y = at[: len(a)], at[len(a) :]
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    keep = label != np.arange(len(names))
    return names[keep], names[label[keep]]


def links(fingerprints: DataFrame, fp: str = "fp", radius: int = RADIUS, pieces: int = PIECES, n_pivots: int = PIVOTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints within ``radius`` (1 or 2) bits that leave the same connected
    classes as all such pairs. ``fingerprints``: distinct values. Two shuffles of pieces-over-radius small rows each."""
    if radius not in (1, 2) or pieces <= radius:
        raise ValueError("radius is 1 or 2 and pieces are more")
    masks = _masks(pieces, radius)
    keyed = fingerprints.select(
        F.col(fp).alias("fp"),
        F.posexplode(F.array(*(F.col(fp).bitwiseAND(F.lit(_signed(m))) for m in masks))).alias("choice", "part"),
    ).select(F.xxhash64("choice", "part").alias("key"), "choice", "fp")
    sized = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = keyed.join(sized, "key")
    return _small(crowded.where(F.col("n") <= bucket_limit), radius, n_pivots).unionByName(_large(crowded.where(F.col("n") > bucket_limit), masks))


def _small(rows: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    def run(_, pdf):
        table = pivots(n_pivots)
        a, b = _forest(*_bucket(np.unique(pdf["fp"].to_numpy()).view(np.uint64), radius, table))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return rows.groupBy("key").applyInPandas(run, "a long, b long")


def _large(rows: DataFrame, masks: list[int]) -> DataFrame:
    free = F.array(*(F.array(*(F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1)) for m in masks))
    balls = rows.select("fp", F.explode(F.transform(F.concat(F.array(F.lit(0).cast("long")), free[F.col("choice")]), lambda flip: F.col("fp").bitwiseXOR(flip))).alias("at"))
    # Fingerprints that meet are linked to the smallest of them; a minimum per point is pre-aggregated by each task.
    low = balls.groupBy("at").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("at", "b")
    return balls.join(low, "at").where("fp > b").select(F.col("fp").alias("a"), "b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node reachable. Alternates linking each
    node's larger and smaller neighbours to the smallest one; a table is written each round, so lineage stays short."""
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("x"), "a", "m")
        small = small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = written(small, "links")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
    raise RuntimeError("components did not settle")


def near_duplicate_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, pieces: int = PIECES, n_pivots: int = PIVOTS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed 64-bit fingerprint) and ``component_id`` (the smallest doc_id
    reachable over links of at most ``radius`` bits). A null id is kept as a row and, having no order, counts last."""
    prints = written(with_fingerprint(documents, text, size, keep=[doc_id]).withColumnRenamed(doc_id, "doc_id"), "prints")
    # Nodes are the distinct fingerprints; a class of equal fingerprints is one node with its smallest document.
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "nodes")
    roots = components(links(nodes.select("fp"), radius=radius, pieces=pieces, n_pivots=n_pivots, bucket_limit=bucket_limit))
    member = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    classes = member.join(member.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One document of each class: the one with the smallest id (of rows with that id and different texts, all that
    differ stay apart only by their fingerprints). Rows with a null id are kept."""
    classes = near_duplicate_classes(documents, doc_id, text, **settings)
    heads = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.min("fp").alias("_fp")).select(F.col("doc_id").alias("_head"))
    # Rows travel as one column, so that no name of theirs can clash.
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col(doc_id).alias("_id"))
    joined = rows.join(heads, F.col("_id") == F.col("_head"), "left").where(F.col("_head").isNotNull() | F.col("_id").isNull())
    return joined.select("row.*")
