"""Near copies at a shingle similarity: the pipeline's own setting, wider than the query's two bits.

Two texts are near copies where the sets of their five-word shingles have a Jaccard similarity of 0.8 or more. Texts of
equal sets are one node. Candidates are

- links of at most two bits between SimHash fingerprints of the sets (pivot tables, :func:`simhash.links`), and
- nodes that agree in one of ``BANDS`` bands of ``ROWS`` min-hashes. A similarity of 0.8 is typically ten bits of the
  fingerprint; parts of 64 bits that find so many are too short to tell texts apart, so the bands do this part.

Every candidate is verified by the exact similarity of both sets, read from the texts; pairs whose sets differ too much in
size aren't candidates. A pair at 0.8 agrees in a band with a probability of 0.9998. Buckets of up to ``SMALL`` nodes give all
their pairs. In a larger one every node meets one node of the bucket, which joins classes of copies; pages of one
template, though, are nearly as similar as near copies are, and only what they don't share tells them apart. So nodes of
crowded buckets are joined once more, exactly, by their rarest shingles: two sets at 0.8 share one of the rarest fifth of
either (counted among these nodes). A shingle that up to ``CROWD`` nodes hold among their rarest gives all pairs of different
classes. One that more nodes hold isn't rare at all: it belongs to a large group of edited copies. Nodes outside the commonest
class of their buckets first meet ``LEADS`` nodes of that class, which joins most of such a group; whatever is then still outside the
commonest class of a shingle meets every node of other classes that holds it (:func:`_rest`), so no link is lost. Places rule out most of
these pairs: what stands before the first shared shingle of two sets, rarest first, isn't shared, and of both sizes together four
ninths must be (``_FITS``). Pairs that signatures
rule out aren't verified: of two sets at 0.8, at most a ninth of both sizes together stands in one of them only, and parities
of these, by places of a hash, differ in no more places than that.

Defined results: null, empty and wordless texts are one class; a text shorter than a shingle is one shingle; one row of
each class stays, by id (null last), hash of the text and place; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import lean, raw_bytes, slices, written

SHINGLE, SIMILARITY, BANDS, ROWS, SMALL, LEADS, CROWD = 5, 0.8, 16, 4, 16, 8, 64
#: Pairs of one node that are verified by one task.
SALT = 64
#: Bits of a signature, and how many nodes of one shingle's rest are met in one task.
BITS, BLOCK = 2048, 1024

#: Whether two sets whose first shared shingle, rarest first, is at these places (from 0) can share as much as 0.8 asks for.
_FITS = "9 * least({a}size - {a}place, {b}size - {b}place) >= 4 * ({a}size + {b}size)"

_SEEDS = np.array([[xxhash.xxh64_intdigest(f"{kind} {i}") | 1 for i in range(BANDS * ROWS)] for kind in ("times", "plus")], np.uint64)


def shingle_set(text: bytes | None) -> np.ndarray:
    return np.unique(np.array(simhash.shingle_hashes(text or b"", SHINGLE), np.uint64))


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: every shingle counts once."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(((2 * ones > len(hashes)).astype(np.uint64) << simhash._SHIFTS).sum(dtype=np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """A name of each band of min-hashes."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        x = hashes[None, i : i + (1 << 12)] * _SEEDS[0][:, None] + _SEEDS[1][:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        low = np.minimum(low, x.min(axis=1))
    return [xxhash.xxh64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]


def _rows(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each row as one column, with a number, its node, fingerprint and bands."""
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col(doc_id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["row"], rows.schema["id"], *T._parse_datatype_string("hash long, node long, fp long, size long, bands array<long>").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out = []
            for x in raw_bytes(batch.column("text")).to_pylist():
                own = shingle_set(x)
                out.append((xxhash.xxh64_intdigest(x or b""), xxhash.xxh64_intdigest(own.tobytes()), fingerprint(own), len(own), bands(own)))
            hashes, nodes, fps, sizes, names = zip(*out, strict=True)
            longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (hashes, nodes, fps, sizes)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(out) + 1, BANDS), pa.int32()), pa.array(np.array(names, np.uint64).view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *longs, lists], names=schema.names)

    return written(rows.mapInArrow(lean(run), schema).withColumn("rid", F.monotonically_increasing_id()), "near-rows")


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    """All pairs of each group of ``key`` that aren't of one ``root`` and whose sizes and places can be similar."""
    lists = rows.groupBy("key").agg(F.collect_list(F.struct("node", "root", "size", "place")).alias("x"))
    fits = f"q.root <> p.root AND {_FITS.format(a='p.', b='q.')}"
    pairs = lists.select(F.explode(F.expr(f"flatten(transform(x, (p, i) -> transform(filter(slice(x, i + 2, size(x)), q -> {fits}), q -> struct(p.node as a, q.node as b))))")).alias("p"))
    return pairs.select("p.a", "p.b")


def _rarest(crowd: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(key, node, root, size, place): the rarest shingles of each node of ``crowd`` (node, root, size, rid), as many as a similar set must
    share one of, without those that no other node holds, and their places among all of the node's."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for i, x in enumerate(raw_bytes(batch.column("text")).to_pylist()):
                own = pa.array(shingle_set(x).view(np.int64))
                at = pa.array(np.full(len(own), i))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("node", "root", "size")), own], names=["node", "root", "size", "key"])

    texts = rows.select("rid", F.col("row")[text].alias("text")).join(crowd, "rid").select("node", "root", "size", "text")
    held = written(texts.mapInArrow(lean(read), "node long, root long, size long, key long"), "near-shingles")
    shared = held.join(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    lists = shared.groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("x"))
    # Of the prefix of size - ceil(0.8 size) + 1 shingles, those held once come first and find nobody.
    wanted = F.expr("size - (4 * size + 4) div 5 + 1 - (size - size(x))").cast("int")
    rare = lists.where(wanted > 0).select("node", "root", "size", (F.col("size") - F.size("x")).alias("alone"), F.posexplode(F.slice("x", 1, wanted)).alias("at", "s"))
    return rare.select("s.key", "node", "root", "size", (F.col("alone") + F.col("at")).alias("place"))


def signature(hashes: np.ndarray) -> bytes:
    """A bit for each place of a hash: whether it holds an odd number of the set's shingles."""
    return np.packbits(np.bincount((hashes % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).tobytes()


def _signed(wanted: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """(node, sig) of ``wanted`` (node, rid)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            own = [signature(shingle_set(x)) for x in raw_bytes(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], names=["node", "sig"])

    texts = rows.select("rid", F.col("row")[text].alias("text")).join(wanted, "rid").select("node", "text")
    return written(texts.mapInArrow(lean(read), "node long, sig binary"), "near-signed")


def _rest(held: DataFrame, rows: DataFrame, nodes: DataFrame, text: str) -> DataFrame | None:
    """Pairs (a, b) of different classes that hold the same shingle: those outside its commonest class, in blocks, with all. ``held``: (key,
    node, size, place, root). Sizes, places and signatures rule pairs out. None if every shingle has one class."""
    by_class = held.groupBy("key", "root").agg(F.count("*").alias("n"))
    top = by_class.groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("classes")).where("classes > 1")
    met = written(held.join(top.select("key", F.col("top.root").alias("top"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("blocks")), "key"), "near-rest")
    if met.isEmpty():
        return None
    met = met.join(_signed(met.select("node").distinct().join(nodes.select("node", "rid"), "node"), rows, text), "node")
    end = lambda df, e, block: df.select("key", block.alias("block"), *(F.col(c).alias(f"{e}_{c}") for c in ("node", "root", "size", "place", "sig")))
    own = end(met.where("root <> top"), "a", F.pmod(F.xxhash64("node"), F.col("blocks")))
    every = end(met, "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    both = own.join(every, ["key", "block"]).where(f"a_root <> b_root AND {_FITS.format(a='a_', b='b_')}")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(raw_bytes(batch.column(c)).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("a_sig", "b_sig"))
            sizes = np.asarray(batch.column("a_size")) + np.asarray(batch.column("b_size"))
            fits = 9 * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= sizes
            yield pa.RecordBatch.from_arrays([batch.column("a_node"), batch.column("b_node")], names=["a", "b"]).filter(pa.array(fits))

    return both.select("a_node", "b_node", "a_size", "b_size", "a_sig", "b_sig").mapInArrow(lean(near), "a long, b long")


def _tight(nodes: DataFrame) -> DataFrame:
    """Nodes whose fingerprints are within two bits."""
    prints = written(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "near-prints")
    equal = nodes.join(prints.where("n > 1"), "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    near = simhash.links(prints.select("fp"))
    at = lambda end: prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node"))
    return equal.unionByName(near.join(at("a"), "a").join(at("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""
    pairs = written(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n"))
    wanted = nodes.select("node", "rid").join(ends, "node")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            own = [shingle_set(x).tobytes() for x in raw_bytes(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), pa.array(own, pa.binary())], names=["node", "n", "own"])

    texts = rows.select("rid", F.col("row")[text].alias("text")).join(wanted, "rid").select("node", "n", "text")
    sets = written(texts.mapInArrow(lean(read), "node long, n long, own binary"), "near-sets")
    # A node of many pairs is dealt over several tasks.
    salts = F.ceil(F.col("n") / SALT)
    hot = sets.where(F.col("n") > SALT).select("node", salts.alias("salts"))
    joined = pairs
    for end, other in (("a", "b"), ("b", "a")):
        copies = sets.select(F.col("node").alias(end), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("own").alias(f"own_{end}"))
        salted = joined.join(hot.withColumnRenamed("node", end), end, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), F.lit(0).cast("long"))).drop("salts")
        joined = salted.join(copies, [end, "salt"]).drop("salt")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (raw_bytes(batch.column(c)).to_pylist() for c in ("own_a", "own_b"))
            good = [similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= SIMILARITY for x, y in zip(left, right, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(joined.select("a", "b", "own_a", "own_b").mapInArrow(lean(check), "a long, b long"), "near-links")


def _classes(rows: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, root) of all nodes that are near another."""
    keyed = nodes.select("node", "size", F.posexplode("bands").alias("band", "key"))
    lead = lambda i: F.min_by("node", F.xxhash64("node", "key", F.lit(i)))
    sized = keyed.groupBy("key").agg(F.count("*").alias("n"), lead(0).alias("lead")).where("n > 1")
    members = written(keyed.join(sized, "key"), "near-buckets")
    crowd = members.where(F.col("n") > SMALL)
    pairs = _pairs_of_small(members.where(F.col("n") <= SMALL).withColumns({"root": F.col("node"), "place": F.lit(0)}))
    links = _verified(pairs.unionByName(crowd.select(F.col("node").alias("a"), F.col("lead").alias("b"))).unionByName(_tight(nodes)), rows, nodes, text)
    roots = written(simhash.components(links), "near-roots")
    if crowd.isEmpty():
        return roots
    placed = crowd.select("node", "key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Nodes of crowded buckets meet by their rarest shingles.
    once = placed.select("node", "root").distinct().join(nodes.select("node", "size", "rid"), "node")
    rare = written(_rarest(once, rows, text), "near-rarest")
    held = rare.join(rare.groupBy("key").agg(F.count("*").alias("n")), "key")
    met = _pairs_of_small(held.where(F.col("n") <= CROWD))
    # What more nodes hold: those outside their bucket's commonest class meet several nodes of that class.
    crowded = written(held.where(F.col("n") > CROWD).select("key", "node", "size", "place"), "near-crowded")
    many = written(crowded.select("node").distinct(), "near-many")
    placed = placed.join(many, "node")
    by_class = placed.groupBy("key", "root").agg(F.count("*").alias("n"), F.array_distinct(F.array(*(lead(i) for i in range(1, LEADS + 1)))).alias("leads"))
    by_class = written(by_class, "near-buckets")
    top = by_class.groupBy("key").agg(F.max(F.struct("n", "root", "leads")).alias("top"), F.count("*").alias("classes")).where("classes > 1").select("key", "top.root", "top.leads")
    strays = placed.join(top.withColumnRenamed("root", "top"), "key").where("root <> top")
    met = met.unionByName(strays.select(F.col("node").alias("a"), F.explode("leads").alias("b"))).distinct()
    links = links.unionByName(_verified(met, rows, nodes, text))
    roots = written(simhash.components(links), "near-roots")
    rest = _rest(crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), rows, nodes, text)
    return roots if rest is None else simhash.components(links.unionByName(_verified(rest, rows, nodes, text)))


def drop_near_copies(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class."""
    rows = _rows(documents, doc_id, text)
    # The least row of a node by id (null last), text and place.
    order = F.struct(F.col("id").isNull().alias("none"), "id", "hash", "rid")
    nodes = written(rows.groupBy("node").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size")).withColumn("rid", F.col("least.rid")), "near-nodes")
    roots = _classes(rows, nodes, text)
    heads = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min("least").alias("least")).select("least.rid")
    return rows.join(heads, "rid", "left_semi").select("row.*")
