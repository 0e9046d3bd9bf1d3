"""Snapshots as files, listings, bins, readers by type, and failures of old jobs."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from studyloom.operators import jobs
from studyloom.sources import documents as D
from studyloom.sources import snapshots


def test_snapshot_files_and_damage(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    pairs = spark.createDataFrame([(p, s, f"文{p}\t{s}", None if s else 1.5) for p in range(30) for s in range(3)], "piece int, seq int, zh string, x double").repartition(5)
    settings = spark.createDataFrame([("a", "1"), ("password_hash", "secret")], "k string, v string")
    manifest = snapshots.write(snapshots.exported({"pairs": (pairs, ["piece", "seq"]), "settings": (settings, ["k"])}), path)
    rows = snapshots.read_rows(spark, path)
    assert sorted(r.row for r in rows.where("section = 'settings'").collect()) == ['{"k":"a","v":"1"}']
    assert {(x["piece"], x["seq"], x["zh"], x["x"]) for x in map(json.loads, (r.row for r in rows.where("section = 'pairs'").collect()))} == {tuple(r) for r in pairs.collect()}
    ranges = sorted((tuple(json.loads(r["first"]).values()), tuple(json.loads(r["last"]).values()), r.rows, r.file) for r in manifest.where("section = 'pairs'").collect())
    # Files are ranges of keys in the order of the keys' own types; inside they are sorted.
    assert sum(x[2] for x in ranges) == 90 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    files = {f.name: f for f in (tmp_path / "s/rows/section=pairs").glob("part-*")}
    for *_, name in ranges:
        keys = [(x["piece"], x["seq"]) for x in map(json.loads, files[name].read_text().splitlines())]
        assert keys == sorted(keys)
    assert snapshots.damage(spark, path).count() == 0
    first, second = (files[x[-1]] for x in (ranges[0], ranges[-1]))
    text = first.read_text()
    for broken in (first, second):
        (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    first.write_text(text.replace("文0", "文9", 1))
    second.unlink() if second != first else None
    (first.parent / "part-extra.txt").write_text("{}\n")
    got = {(r.file, r.problem) for r in snapshots.damage(spark, path).collect()}
    assert got == {(first.name, "changed"), ("part-extra.txt", "unknown")} | ({(second.name, "missing")} if second != first else set())


def test_client_start(spark, tmp_path):
    projects = spark.createDataFrame([(1, None), (2, "2024-01-01")], "id int, deleted_at string")
    pieces = spark.createDataFrame([(1, None), (2, "2024-01-01")], "id int, deleted_at string")
    snapshots.write(snapshots.started({"projects": (projects, ["id"]), "pieces": (pieces, ["id"])}), f"file://{tmp_path}/c")
    got = sorted((r.section, r.row) for r in snapshots.read_rows(spark, f"file://{tmp_path}/c").collect())
    assert got == [("pieces", '{"id":1,"deleted_at":null}'), ("pieces", '{"id":2,"deleted_at":"2024-01-01"}'), ("projects", '{"id":1}')]


def test_bin(spark, tmp_path):
    for name, day in (("old.txt", 1), ("deep/older.txt", 2), ("empty.txt", 0), ("new.txt", 20)):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"x" * day)
        os.utime(f, (1704067200 + day * 86400,) * 2)
    path = f"file://{tmp_path}"
    assert D.usage_bytes(D.listed(spark, path)).first()[0] == 23
    assert D.purge(spark, path, "2024-01-25 00:00:00", 10) == 3 and sorted(f.name for f in tmp_path.rglob("*.txt")) == ["new.txt"]
    assert D.purge(spark, path, "2024-01-25 00:00:00", 10) == 0
    plan = D.listed(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan


def listed(data):
    return [(i, x) for i, x in enumerate(data.decode().split(",")) if x]


def failing(data):
    raise ValueError("broken")


def test_readers_by_type(spark, tmp_path):
    contents = {"a.TXT": "一。\n\nb".encode(), "b.md": b" \n", "c.list": b"x,y", "d.list": b",", "zero.md": b"", "e.bad": b"1", "f.doc": b"1", "g.txt": b"\xff\xff\xff", "none": b"1"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    rows = D.read_documents(spark, f"file://{tmp_path}", {".list": listed, ".bad": failing}).select(F.substring_index("path", "/", -1).alias("name"), "block_no", "page", "text", "zh_ratio", "error").collect()
    assert sorted(map(tuple, rows), key=repr) == sorted([
        ("a.TXT", 0, 0, "一。", 1.0, None), ("a.TXT", 1, 0, "b", 0.0, None), ("b.md", None, None, None, None, "empty"), ("c.list", 0, 0, "x", 0.0, None), ("c.list", 1, 1, "y", 0.0, None), ("d.list", None, None, None, None, "empty"),
        ("e.bad", None, None, None, None, "failed: broken"), ("f.doc", None, None, None, None, "no_parser"), ("g.txt", None, None, None, None, "failed: encoding"), ("none", None, None, None, None, "no_parser"),
    ], key=repr)
    assert {r.error for r in D.read_documents(spark, f"file://{tmp_path}").select("error").distinct().collect()} == {None, "empty", "no_parser", "failed: encoding"}


def test_old_failures(spark):
    units = spark.createDataFrame([(1, "0001:a", "a"), (1, "0002:b", "b"), (1, "0003:b", "b"), (1, "0004:d", "d"), (2, "0001:a", "a")], "job int, unit_key string, title string")
    done = spark.createDataFrame([(1, "d"), (2, "x")], "job int, unit_key string")
    failures = spark.createDataFrame([(1, "a", None, 1), (1, "a", "0001:a", 2), (1, "a", "", 3), (1, "b", None, 4), (1, "b", "0002:b", 5), (1, "d", None, 6), (1, "zz", None, 7), (2, "a", None, 8)], "job int, title string, unit_key string, place int")
    assert sorted(map(tuple, jobs.migrated_failures(failures, done, units, "job").collect())) == [(1, "a", "0001:a", 3), (1, "b", "0002:b", 5), (2, "a", "0001:a", 8)]
