"""Answers of models: how they are read, asked for again, stitched together and checked."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from studyloom.operators import alignment as A
from studyloom.operators import model_alignment as M

RIGHT = '[{"zh":1,"en":[1]},{"zh":2,"en":[2,3]}]'
#: Answers for two sentences and three, and what they are.
ANSWERS = [
    (RIGHT, None), (f"x ```json\n{RIGHT}\n``` y [1]", None), (f"so {RIGHT} it is", None), ('[[1,1],[2,[3,2]]]', None), ('[{"zh_indices":[1],"en_idx":1},{"zh_idx":2,"en":["2"," 3 "]}]', None), ('[[1,[1.9]],[[2],[2,3]]]', None),
    ("none", "llm_bad_json"), ("[1", "llm_bad_json"), ("] [", "llm_bad_json"), ('{"zh":1}', "llm_bad_json"), (None, "llm_bad_json"), ('[[1,1]] x', "llm_bad_json"), ("[]", "llm_empty"),
    ('[{"zh":"12","en":[1,2]}]', "llm_bad_shape"), ('[{"zh":{"1":0,"2":0},"en":1}]', "llm_bad_shape"), ('[{"zh":9,"en":[]}]', "llm_bad_shape"), ('[{"zh":[],"en":1}]', "llm_bad_shape"), ('[{"zh":1}]', "llm_bad_shape"), ('[{"zh":null,"zh_idx":1,"en":1}]', "llm_bad_shape"),
    ("[1,2]", "llm_bad_shape"), ("[[1,1,1]]", "llm_bad_shape"), ('[[1,["x"]]]', "llm_bad_shape"), ("[[1,[null]]]", "llm_bad_shape"), ("[[1,[[1]]]]", "llm_bad_shape"), ("[[1.0,1]]", "llm_bad_shape"), ("[[1,12345678901234567890]]", "llm_out_of_range"),
    ('[{"zh":3,"en":1}]', "llm_out_of_range"), ('[{"zh":0,"en":1}]', "llm_out_of_range"), ('[[1,[1,4]]]', "llm_out_of_range"), ('[{"zh":2,"en":1},{"zh":1,"en":2}]', "llm_not_monotonic"), ("[[1,1],[2,1]]", "llm_not_monotonic"),
    ('[{"zh":1,"en":[1,3]}]', "llm_not_contiguous"), ("[[1,[1,1]]]", "llm_not_contiguous"), ('[{"zh":1,"en":1}]', "llm_incomplete"), ("[[1,1],[2,2]]", "llm_incomplete"), ("[[1,1],[5,9],[0,0]]", "llm_out_of_range"), ("[[1,1],3,[9,9]]", "llm_bad_shape"),
]


def test_answers(spark):
    rows = spark.createDataFrame([(i, a, 2, 3) for i, (a, _) in enumerate(ANSWERS)], "i int, answer string, n_zh int, n_en int")
    got = M.read_mappings(rows).orderBy("i").collect()
    assert [(ANSWERS[r.i][0], r.error) for r in got] == ANSWERS
    assert all([tuple(g) for g in r.groups] == [(0, 1, 0, 1), (1, 2, 1, 3)] for r in got if r.error is None)
    assert all(r.groups is None for r in got if r.error)


def test_large_groups(spark):
    rows = spark.createDataFrame([('[[[1,2,3,4],1]]', 4, 1), ('[[[1,2,3,4,5],1]]', 5, 1), ('[[1,[1,2,3,4,5]]]', 1, 5)], "answer string, n_zh int, n_en int")
    assert [r.error for r in M.read_mappings(rows).collect()] == [None, "llm_oversize", "llm_oversize"]


def script(messages):
    """By the first sentence's letter: right; an error that passes; an error that doesn't; wrong twice; wrong once; wrong in
    the second block; coarse."""
    text, again = messages[1], len(messages) > 2
    block, kind, n = text[2:].split("\n")[0].strip(), text.split("[1] ")[1][0], int(text.split("（")[1].split("）")[0])
    ones = json.dumps([[i, i] for i in range(1, n + 1)])
    if kind == "b" and not again:
        raise M.ModelError("rate_limited", "slow down")
    if kind == "c":
        raise M.ModelError("auth")
    if kind == "d" or (kind == "e" and not again) or (kind == "f" and block == "2"):
        return "no", 7, 1
    if kind == "e":
        assert "llm_bad_json" in messages[2]
    return (json.dumps([[list(range(1, n + 1))] * 2]) if kind == "g" else ones), 7, 1


@pytest.fixture(scope="module")
def pieces(spark):
    side = lambda k, n: [f"{k}{'字' * 9}。" for _ in range(n)]
    rows = [(k, side(k, 6), [f"{k} some words here." for _ in range(6)]) for k in "abcdefg"]
    rows[0][2][2] = "a word, and then more words than all others have."
    return spark.createDataFrame([*rows, ("h", ["x。"], [" "]), ("i", None, ["x."]), ("j", [], [])], "id string, zh array<string>, en array<string>")


def test_blocks_and_attempts(spark, pieces):
    solid = A.solid_sides(pieces, "zh", "en")
    asked = M.blocks(solid, ["id"], size=2)
    assert [(r.block, r.zh_at, r.en_at, r.n_zh) for r in asked.where("id = 'a'").orderBy("block").collect()] == [(0, 0, 0, 2), (1, 2, 2, 2), (2, 4, 4, 2)]
    told = M.ask(asked, ["id"], script)
    got = {(r.id, r.block): (r.error, r.attempts, r.prompt_tokens) for r in told.collect()}
    assert {k: v for k, v in got.items() if k[1] == 0} == {("a", 0): (None, 1, 7), ("b", 0): (None, 2, 7), ("c", 0): ("auth", 1, 0), ("d", 0): ("llm_bad_json", 2, 14), ("e", 0): (None, 2, 14), ("f", 0): (None, 1, 7), ("g", 0): (None, 1, 7)}
    assert got["f", 1] == ("llm_bad_json", 2, 14) and got["f", 2][0] is None
    whole = {r.id: (r.error, r.groups and [tuple(g) for g in r.groups]) for r in M.stitched(told, ["id"]).collect()}
    assert whole["a"] == (None, [(i, i + 1, i, i + 1) for i in range(6)]) and whole["f"] == ("llm_bad_json", None) and whole["g"] == (None, [(0, 2, 0, 2), (2, 4, 2, 4), (4, 6, 4, 6)])


def test_pairs_and_agreement(spark, pieces):
    rows = M.pairs(pieces, ["id"], script, size=2).orderBy("id", "seq").collect()
    by = {k: [r for r in rows if r.id == k] for k in "abcdefghij"}
    assert not by["h"] and not by["i"] and not by["j"]
    # All cuts agree: full confidence, and the long sentence's flag is taken back; by balanced lengths it stays.
    assert [r.flagged_by for r in A.flag(A.align(pieces.where("id = 'a'"), ["id"]), ["id"]).orderBy("seq").collect()] == [None, None, "length_ratio", None, None, None]
    assert [(r.how, r.confidence, r.agreement, r.needs_review) for r in by["a"]] == [("llm", 1.0, 1.0, False)] * 6
    assert [(r.how, r.error, r.agreement) for r in by["c"]] == [("direct", "auth", None)] * 6
    assert {r.error for r in by["d"] + by["f"]} == {"llm_bad_json"} and {r.how for r in by["b"] + by["e"]} == {"llm"}
    # Three of six cuts are the model's: F1 is two thirds, below the floor.
    assert [(r.how, r.confidence, round(r.agreement, 6), r.flagged_by) for r in by["g"]] == [("llm", 0.5, 0.666667, "agreement")] * 3


def test_agreement_between(spark):
    values = spark.createDataFrame([(1.0,), (0.9991,), (0.9,), (0.8,), (0.1,)], "a double")
    got = [r[0] for r in values.select(A.agreement_confidence(F.col("a"))).collect()]
    assert [round(x, 6) for x in got] == [1.0, 1.0, 0.775, 0.5, 0.5]


def test_no_pieces(spark, pieces):
    assert M.pairs(pieces.where("false"), ["id"], script).count() == 0


def test_right_answers_are_not_searched(spark):
    """What is wrong is looked for in wrong answers alone, and no block without sentences counts as mapped."""
    answers = [(RIGHT, 2, 3), ("[[1,1],[2,2]]", 2, 2), ("[[[2,1],[1,2]]]", 2, 2), ("[[1,1],[0,0]]", 0, 0), ("[[1,1]]", 1, 0), ("[[1,[]],[2,[1,2]]]", 2, 2), ("[[1,1],[1,2]]", 2, 2), ("[[1,1],[2,null]]", 2, 2)]
    df = M.read_mappings(spark.createDataFrame([(i, *a) for i, a in enumerate(answers)], "i int, answer string, n_zh int, n_en int"))
    assert "_right" in df._jdf.queryExecution().optimizedPlan().toString() and "_right" not in df.columns
    assert [r.error for r in df.orderBy("i").collect()] == [None, None, None, "llm_out_of_range", "llm_out_of_range", "llm_bad_shape", "llm_not_monotonic", "llm_bad_shape"]
