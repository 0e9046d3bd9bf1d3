"""Rules of projects and replaced projects on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from studyloom.operators import rules
from studyloom.sources import projects

RULES = "id string, project_id int, match_on string, kind string, pattern string, category string, enabled boolean, priority int"


def test_first_rule_that_fits(spark):
    table = spark.createDataFrame([
        ("b", 1, "file_name", "prefix", "ab", "B", True, 0), ("a", 1, "file_name", "contains", "b", "A", True, 0), ("c", 1, "unit_title", "regex", r"(?i)^t\d+$", "C", True, -1), ("d", 1, "file_name", "regex", "((", "D", True, -9),
        ("e", 1, "file_name", "prefix", "a", "E", False, -9), ("f", 1, "file_name", "contains", " ", "F", True, -9), ("g", 1, "file_name", "glob", "a", "G", True, -9), ("h", 2, "unit_title", "contains", "x", "H", True, 0),
    ], RULES)
    units = spark.createDataFrame([(1, 1, "abc", "x"), (2, 1, "xb", "T12"), (3, 1, None, None), (4, 2, None, "x"), (5, None, "abc", "x"), (6, 3, "abc", "x")], "u int, project_id int, file_name string, unit_title string")
    got = rules.classify(units, table, ["u"]).orderBy("u").collect()
    assert [r.rule_category for r in got] == ["A", "C", None, "H", None, None]


@pytest.mark.parametrize(("change", "why"), [({"match_on": "body"}, "match_on"), ({"kind": None}, "kind"), ({"pattern": " "}, "pattern"), ({"pattern": None}, "pattern"), ({"category": "　"}, "category"), ({"kind": "regex", "pattern": "["}, "regex"), ({}, None)])
def test_refused_rules(spark, change, why):
    row = {"project_id": 1, "place": 1, "match_on": "file_name", "kind": "prefix", "pattern": "a", "category": "c", "enabled": True} | change
    puts = spark.createDataFrame([tuple(row.values()), (1, 0, "unit_title", "regex", "^a", " b ", True), (2, 5, "unit_title", "contains", " a ", "b", False)], "project_id int, place int, match_on string, kind string, pattern string, category string, enabled boolean")
    old = spark.createDataFrame([("x", 1, "file_name", "prefix", "p", "old", True, 4), ("y", 2, "file_name", "prefix", "p", "old", True, 4), ("z", 3, "file_name", "prefix", "p", "old", True, 4)], RULES)
    table, refused = rules.put_rules(old, puts)
    assert [(r.place, r.refused) for r in refused.collect()] == ([(1, why)] if why else [])
    got = sorted((r.project_id, r.priority, r.pattern, r.category) for r in table.collect())
    first = [(1, 4, "p", "old")] if why else [(1, 0, "^a", "b"), (1, 1, "a", "c")]
    assert got == [*first, (2, 0, "a", "b"), (3, 4, "p", "old")]


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("part-*.parquet")}


def test_only_touched_parts_are_written(spark, tmp_path):
    path, schema = f"file://{tmp_path}/t", "project_id int, x string"
    table = lambda rows: spark.createDataFrame(rows, schema)
    rows = lambda: sorted(map(tuple, projects.read(spark, path).collect()))
    projects.replace(path, table([(p, f"a{p}") for p in range(40)]), spark.range(40).select(F.col("id").cast("int").alias("project_id")), parts=8)
    before = files(tmp_path / "t")
    for _ in range(2):  # a write that runs again changes nothing
        projects.replace(path, table([(3, "new"), (3, "newer")]), table([(3, ""), (50, "")]), parts=8)
        assert rows() == sorted([(p, f"a{p}") for p in range(40) if p != 3] + [(3, "new"), (3, "newer")])
    own = {r[0] for r in spark.createDataFrame([(3,), (50,)], "p int").select(projects.part_of(F.col("p"), 8)).collect()}
    same = {f for f, t in files(tmp_path / "t").items() if before.get(f) == t}
    assert {int(f.split("_part=")[1].split("/")[0]) for f in before.keys() - same} == own and same
    # The last project of a part goes; a put of nothing touches nothing.
    projects.replace(path, table([]), spark.range(40).select(F.col("id").cast("int").alias("project_id")), parts=8)
    projects.replace(path, table([]), table([]), parts=8)
    assert rows() == []


def test_nothing_stored_yet(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    rows = spark.createDataFrame([(1, 7, 0, "a", False)], "project_id int, piece_id int, seq int, zh string, manually_edited boolean")
    assert projects.read(spark, path, rows.schema).count() == 0
    staged = spark.createDataFrame([(1, 7, True), (1, 8, False)], "project_id int, piece_id int, ok boolean")
    assert {(r.piece_id, r.outcome) for r in projects.save_pieces(path, staged, rows, ["piece_id"]).collect()} == {(7, "created"), (8, "rejected")}
    hand = rows.withColumn("manually_edited", F.lit(True))
    assert {r.outcome for r in projects.save_pieces(path, staged, hand, ["piece_id"]).collect()} == {"replaced", "rejected"}
    assert {(r.outcome, r.wiped_edits) for r in projects.save_pieces(path, staged, rows, ["piece_id"]).collect()} == {("skipped", 1), ("rejected", 0)}
    assert {r.outcome for r in projects.save_pieces(path, staged, rows, ["piece_id"], overwrite=True).collect()} == {"replaced", "rejected"}
    assert [tuple(r) for r in projects.read(spark, path).select("project_id", "piece_id", "seq", "zh", "manually_edited").collect()] == [(1, 7, 0, "a", False)]


def test_rejected_graphs(spark, tmp_path):
    nodes = spark.createDataFrame([(1, "n"), (2, "m")], "project_id int, node_id string")
    drafts = spark.createDataFrame([(1, "f"), (2, None), (3, "f")], "project_id int, file_id string")
    done = projects.save_graph(f"file://{tmp_path}/g", {"nodes": nodes}, drafts)
    assert {(r.project_id, r.outcome, r.reason) for r in done.collect()} == {(1, "replaced", None), (2, "rejected", "graph_no_file"), (3, "rejected", "graph_empty")}
    assert [r.node_id for r in projects.read(spark, f"file://{tmp_path}/g/nodes").collect()] == ["n"]


def test_pieces_meet_what_is_stored_by_one_shuffle(spark, tmp_path, monkeypatch):
    plans, overwrite = [], projects._overwrite
    monkeypatch.setattr(projects, "_overwrite", lambda path, rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or overwrite(path, rows))
    monkeypatch.setattr(projects, "replace", None)
    path = f"file://{tmp_path}/one"
    rows = spark.range(60).selectExpr("cast(id % 20 % 7 as int) as project_id", "cast(id % 20 as int) as piece_id", "cast(id as int) as seq", "'a' as zh", "false as manually_edited")
    staged = rows.selectExpr("project_id", "piece_id", "piece_id % 3 > 0 as ok").distinct()
    for keys in (["piece_id"], ["project_id", "piece_id"]):
        projects.save_pieces(path, staged, rows, keys)
    assert [p.count("Exchange ") for p in plans] == [1, 1]
    assert sorted(projects.read(spark, path).select(*rows.columns).collect()) == sorted(rows.where("piece_id % 3 > 0").collect())


def test_pieces_that_moved(spark, tmp_path):
    """A piece that is saved under another project leaves the projects that are touched, and stays in the others; pieces that aren't staged stay."""
    path, schema = f"file://{tmp_path}/moved", "project_id int, piece_id int, seq int, zh string, manually_edited boolean"
    table = lambda rows: spark.createDataFrame(rows, schema)
    ok = lambda rows: spark.createDataFrame([(*r, True) for r in rows], "project_id int, piece_id int, ok boolean")
    before = [(1, 7, 0, "a", False), (1, 8, 0, "b", False), (2, 7, 0, "c", False), (3, 7, 0, "d", False), (3, 9, 0, "e", False), (4, 5, 0, "f", True)]
    projects.replace(path, table(before), spark.range(1, 5).selectExpr("cast(id as int) as project_id"))
    done = projects.save_pieces(path, ok([(5, 7), (1, 6), (3, 4), (4, 5)]), table([(5, 7, 0, "new", False), (1, 6, 0, "g", False), (3, 4, 0, "h", False), (4, 5, 0, "no", False), (1, 99, 0, "unstaged", False)]), ["piece_id"])
    assert {(r.piece_id, r.outcome, r.wiped_edits) for r in done.collect()} == {(7, "replaced", 0), (6, "created", 0), (4, "created", 0), (5, "skipped", 1)}
    assert set(done.columns) == {"project_id", "piece_id", "ok", "outcome", "wiped_edits"}
    got = sorted(tuple(r) for r in projects.read(spark, path).select(*schema.replace(" int", "").replace(" string", "").replace(" boolean", "").split(", ")).collect())
    assert got == [(1, 6, 0, "g", False), (1, 8, 0, "b", False), (2, 7, 0, "c", False), (3, 4, 0, "h", False), (3, 9, 0, "e", False), (4, 5, 0, "f", True), (5, 7, 0, "new", False)]
