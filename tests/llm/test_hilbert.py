"""The curve visits every cell once by steps to neighbours; shards follow their law."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from studyloom.llm import hilbert
from studyloom.llm.queries import op8_hilbert_shards
from studyloom.session import table

from .conftest import odd_rows


def test_curve_is_a_walk_through_all_cells():
    for n, bits in ((2, 3), (3, 3), (4, 2)):
        points = np.indices((1 << bits,) * n).reshape(n, -1).T
        index = hilbert.hilbert_index(points, bits)
        assert sorted(index) == list(range(len(points)))
        walk = points[np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def check(rows, docs):
    assert len(rows) == len(docs)
    want = sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in docs)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40))
    sizes = [len(slots.get(s, ())) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    order = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)


def test_query(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    rows = op8_hilbert_shards(spark, small).collect()
    check(rows, docs)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def places(stored):
    body = F.coalesce("row.text", F.lit(""))
    return stored.select("row.doc_id", (F.octet_length(body) + 16).alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), "shard", "slot", "curve")


def test_odd_rows_are_stored_once_each(spark, odd, empty, tmp_path):
    clashing = odd.withColumn("shard", F.lit("x")).withColumn("curve", F.lit(0)).withColumn("_size", F.lit(1))
    stored = hilbert.write_shards(hilbert.shard_documents(clashing.fillna({"doc_id": -1})), str(tmp_path / "shards"))
    check(places(stored).collect(), [(-1 if d is None else d, t) for d, t, *_ in odd_rows()])
    assert stored.select("row.*").columns == clashing.columns
    nulls = hilbert.write_shards(hilbert.shard_documents(odd), str(tmp_path / "nulls")).select("row.*")
    assert sorted(map(repr, nulls.collect())) == sorted(map(repr, odd.collect()))
    assert hilbert.write_shards(hilbert.shard_documents(empty), str(tmp_path / "none")).count() == 0


def test_shards_prune_names_and_sizes(spark, small):
    stored = hilbert.shard_documents(table(spark, small, "documents"))
    ranges = hilbert.shard_ranges(stored, ["n_chars", "source", "lang"]).collect()
    sizes = sorted(r["row"]["n_chars"] for r in stored.collect())
    middle = sizes[len(sizes) // 2]
    # A filter on any one dimension leaves out many shards.
    assert np.mean([r.n_chars_min <= middle <= r.n_chars_max for r in ranges]) < 0.8
    assert np.mean([r.lang_min <= "en" <= r.lang_max for r in ranges]) < 0.9  # one of four values, five rows a shard
    assert np.mean([r.source_min <= "src3" <= r.source_max for r in ranges]) < 0.8


def test_codes_follow_the_order_of_names(spark):
    rows = spark.createDataFrame([(f"https://a{i:04d}é", i) for i in range(500)] + [(None, None)], "name string, n long")
    (name, n), cuts = hilbert.dimensions(rows, ["name"], ["n"])
    got = [(r.a, r.b) for r in rows.orderBy("name").select(name.alias("a"), n.alias("b")).collect() if r.a is not None]
    assert got == sorted(got) and len({a for a, _ in got}) == 500 and all(30 <= len(c) < 64 for c in cuts)
