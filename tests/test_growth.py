"""Tables are read, and costly columns made, once in a plan."""

from __future__ import annotations

import re
from itertools import product

import pytest
from pyspark.sql import functions as F

from studyloom import plans, session
from studyloom.functions import text as X
from studyloom.operators import alignment, graph
from studyloom.plans import work

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["graph_nodes", "graph_edges"])
def test_a_draft_is_made_once(spark, name):
    """Lines and orders are read once, also where nodes meet their categories and links their ends."""
    plan = optimized(plans.QUERIES[name](spark, SF))
    assert plan.count("Relation [") == 2 and plan.count("Join ") == 1


def test_zero_filled(spark):
    rows = spark.range(1).selectExpr("explode(array(0, 7, 99, 100, 12345)) as n").select(X.zero_filled(F.col("n"), 2).alias("s")).collect()
    assert [r.s for r in rows] == ["00", "07", "99", "100", "12345"]


def test_ratios_and_ends_by_the_definition(spark):
    """Short ways (ASCII texts, trimming by a list of characters) against the definition."""
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = [*(f"{c}a {c}b{c}" for c in spaces), *spaces, "", "a", "12", "é", "甲a 乙", "　甲　", "甲乙", "、", "​ x", "甲 a\n", None]
    cjk = lambda c: any(a <= ord(c) <= b for a, b in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x3040, 0x30FF), (0xAC00, 0xD7AF), (0x3000, 0x303F), (0xFF00, 0xFFEF)))
    latin = lambda c: c.isascii() and c.isalpha() or 0xC0 <= ord(c) <= 0x24F

    def wanted(t):
        if t is None:
            return None, None, None
        solid, zh, en = "".join(t.split()), sum(map(cjk, t)), sum(map(latin, t))
        return t.strip(), sum(map(cjk, solid)) / len(solid) if solid else 0.0, 0.0 if not t else zh / (zh + en) if zh + en else 1.0

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.strip(F.col("t")).alias("s"), X.cjk_ratio(F.col("t")).alias("c"), X.zh_ratio(F.col("t")).alias("z")).collect()
    assert [tuple(r) for r in got] == [wanted(t) for t in texts]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_a_stored_draft_is_written_once(spark, monkeypatch):
    """Categories are read from the written nodes, and stored nodes move once to become edges."""
    names, stored = [], work.stored
    monkeypatch.setattr(work, "stored", lambda df, name: names.append(name) or stored(df, name))
    nodes, categories = work.stored_draft(spark, SF)
    assert names == ["draft-nodes"] and exchanges(work.edges_of(nodes, nodes)) == 1
    assert sorted(categories.collect()) == sorted(work.draft(spark, SF)[1].collect())


@pytest.mark.parametrize("name", ["graph_nodes", "graph_categories", "pair_split", "done_marks"])
def test_tasks_follow_the_rows(spark, monkeypatch, name):
    """A larger table is dealt into more tasks, with the same rows."""
    usual = sorted(map(repr, plans.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 400)
    rows = session.table(spark, SF, "lineitem").count()
    df = plans.QUERIES[name](spark, SF)
    assert f", {rows // 400 + 1})" in df._jdf.queryExecution().executedPlan().toString() and rows // 400 > 4
    assert sorted(map(repr, df.collect())) == usual


def test_pairs_move_as_few_columns(spark):
    """Texts of a pair, and its key, are made after its line was moved."""
    plan = optimized(plans.QUERIES["pair_page"](spark, SF))
    assert "concat_ws" not in plan[plan.index("RepartitionByExpression") :]


def test_ids_are_compared_as_bytes(spark):
    assert optimized(plans.QUERIES["graph_stored"](spark, SF)).count("unhex") >= 4


def test_edits_that_say_nothing_stay_behind(spark):
    nodes = spark.createDataFrame([(1, f"n{i}", "a", "s", "c0") for i in range(5)], "p int, node_key string, name string, summary string, category_key string")
    categories = spark.createDataFrame([(1, "c0", 0)], "p int, category_key string, sort_order int")
    edits = spark.createDataFrame([(1, "n0", None, None, "", None), (1, "n1", False, None, None, ""), (1, "n2", True, None, None, None), (1, "n3", None, "x", None, None), (1, "n4", None, None, None, "t")], "p int, node_key string, deleted boolean, to_category string, new_name string, new_summary string")
    df = graph.edited_nodes(nodes.withColumn("edited", F.lit(False)), categories, edits, ["p"])
    assert sorted((r.node_key, r.name, r.summary, r.category_key, r.edited) for r in df.collect()) == [("n0", "a", "s", "c0", False), ("n1", "a", "s", "c0", False), ("n3", "a", "s", "c0", False), ("n4", "a", "t", "c0", True)]


def test_plain_texts_are_not_searched_for_letters(spark):
    """Both ratios and the tokens have a short way for ASCII texts."""
    rows = spark.createDataFrame([("",), ("abcd",), ("甲a1",), ("éééé",), (None,)], "t string")
    df = rows.select(X.estimate_tokens(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [0, 2, 2, 2, None] and "octet_length" in df._jdf.queryExecution().analyzed().toString()


def test_pieces_are_made_once_and_pairs_need_no_window(spark):
    """Answers meet written pieces; the ratio of a piece is made of its own row before its pairs part."""
    plan = optimized(plans.QUERIES["mapped_pairs"](spark, SF))
    assert "l_orderkey" not in plan and "Window" not in plan


def test_pieces_and_answers_are_not_broadcast(spark):
    assert "Broadcast" not in plans.QUERIES["mapped_pairs"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sentences_of_a_pair_are_counted_once(spark):
    assert optimized(plans.QUERIES["align_regular"](spark, SF)).count("[。！？.!?]+") == 2


def test_sentence_counts_by_the_definition(spark):
    texts = ["", " \n", "1.5", "1.2.3", "a.b", "3!4?5.", "٣.٤", "x。1.2！?", "1..2", "no 0001.", "第12号0001。", "　", "a", "1.2 3.4", None]
    texts += ["".join(p) for n in (1, 2, 3, 4) for p in product("1.!。 ", repeat=n)]

    def wanted(t):
        marks = re.sub(r"[。！？.!?]", "", ends := re.sub(r"\d[.!?]\d", "\x01", t or ""))
        return max(1, len(ends) - len(marks))

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.count_sentences(F.col("t")).alias("n"))
    assert [(r.t, r.n) for r in df.collect()] == [(t, wanted(t)) for t in texts]


def test_pieces_of_the_same_sizes_are_aligned_once(monkeypatch):
    filled, fill = [], alignment._fill
    monkeypatch.setattr(alignment, "_fill", lambda zh, en: filled.append(len(zh)) or fill(zh, en))
    zh, en = [[5, 6, 7], [9, 2], [5, 6, 7], [1], [], [5, 6, 7]], [[11, 12, 13], [4, 18], [11, 12, 13], [1, 1, 1, 1, 1], [3], [14, 12, 10, 20]]
    got = alignment.balanced(zh, en)
    assert sum(filled) == 3 and got[0] == got[2] and got[3] is None and got[4] is None
    assert got == [alignment.balanced([z], [e])[0] for z, e in zip(zh, en, strict=True)]
