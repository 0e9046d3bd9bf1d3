"""Small inline fixtures, Chinese text among them, that the driver tables don't have."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from studyloom.functions import text as X
from studyloom.operators import alignment, graph, jobs, quality, structure, sync
from studyloom.operators.cleaning import page_groups
from studyloom.sources import documents as D

SAMPLE = [
    ("某地口语练习册", 0), ("（2）江边古城介绍说明讲解（2 题）。", 0), ("这一段是题外话", 0), ("范文（三）", 1),
    ("亲爱的游客朋友们，这里是江边古城。", 1), ("请看左边的城墙，谢谢大家！", 1), ("Dear tourists and friends, this is the old town by the river.", 2), ("Look at the wall on the left. Thank you all!", 2),
    ("（五）湖心小岛讲解", 3), ("范文（四）", 3), ("这里是湖心小岛。", 3), ("请慢走。", 4), ("This is the small island.", 4), ("Mind your step.", 5),
]


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t"))).collect()]


def test_language_and_counts(spark):
    texts = ["上海", "Hello", "上海ab", "2024 年", "123", "", "。 a"]
    assert column(spark, texts, X.zh_ratio) == [1.0, 0.0, 0.5, 1.0, 1.0, 0.0, 0.5]
    assert column(spark, texts, X.language) == ["zh", "en", "zh", "zh", "zh", "en", "zh"]
    assert column(spark, ["上海 a　", "", " "], X.cjk_ratio) == [2 / 3, 0.0, 0.0]
    assert column(spark, ["3.14 is. 真的！", "", "a", "x.y! z?"], X.count_sentences) == [2, 1, 1, 3]
    assert column(spark, ["上海abcd", "", "abc", "上海。"], X.estimate_tokens) == [4, 0, 1, 3]


def test_junk_lines(spark):
    lines = ["第 5 页，共 50 页", "第5页", "Page 3 of 9", "- 7 -", "12", "12345", "——", "  ", "公众号abc", "欢迎关注我们", "正文", "GZH x"]
    assert column(spark, lines, X.junk_reason) == ["page_no", "page_no", "page_no", "page_no", "page_no", None, "noise", "noise", "watermark", None, None, "watermark"]


def test_segments(spark):
    got = column(spark, ["甲乙丙。\n \n丁戊己！", "没有标点的一行\n接着的一行", "问吗？答。Yes. No! 2.75 kg", "\t\n\n ", "短。\n长长长长的话"], X.segments)
    assert got == [["甲乙丙。", "丁戊己！"], ["没有标点的一行接着的一行"], ["问吗？", "答。", "Yes.", "No!", "2.75 kg"], [], ["短。", "长长长长的话"]]
    assert column(spark, ["一。二。三四五？"], lambda t: X.segments(t, 3)) == [["一。二。", "三四五？"]]


def test_small_texts(spark):
    assert column(spark, ["甲乙。丙丁", "甲乙丙丁", "甲"], lambda t: F.to_json(X.split_zh_half(t))) == ['{"a":"甲乙。","b":"丙丁"}', '{"a":"甲乙","b":"丙丁"}', '{"a":"甲","b":""}']
    assert column(spark, ["3:00", "3：05", "3:75", "90", "5", "99999", "", "3:", "abc"], X.parse_clock) == [180, 185, None, 90, 10, 3600, None, None, None]
    assert column(spark, [65, 5, -3], X.format_countdown, "int") == ["1:05", "0:05", "0:00"]
    assert column(spark, ["key sk-abcdef123 " + "a" * 40], X.scrub) == ["key *** ***"]
    assert column(spark, ["“甲”，乙…"], lambda t: X.in_source(F.lit('"甲",乙...'), t)) == [True]


def sample_lines(spark):
    blocks = spark.createDataFrame([(1, i, p, t) for i, (t, p) in enumerate(SAMPLE)], "doc_id int, block_no int, page int, text string")
    return structure.scan(blocks, ["doc_id"])


def test_structure_scan(spark):
    lines = sample_lines(spark).orderBy("n").collect()
    assert [(r.n, r.kind) for r in lines if r.kind in ("area", "piece", "note")] == [(0, "note"), (1, "area"), (2, "note"), (3, "piece"), (8, "area"), (9, "piece")]
    pieces = structure.pieces(sample_lines(spark), ["doc_id"]).orderBy("piece").collect()
    assert [p.title.split("·")[-1] for p in pieces] == ["范文（三）", "范文（四）"] and pieces[1].area == "湖心小岛"
    assert [(p.zh_page, p.en_page, p.page) for p in pieces] == [(1, 2, 1), (3, 4, 3)]
    assert pieces[0].zh == "这里是江边古城。\n请看左边的城墙，谢谢大家！" and pieces[1].en == "This is the small island.\nMind your step."
    assert pieces[1].zh_blocks == [10] * 8 + [11] * 4


def leftmost(source, wanted):
    """Places of the leftmost way through, by looking at every character in turn."""
    out, at = [], 0
    for c in wanted:
        found = [i for i in range(at, len(source)) if source[i] == c]
        out.append(found[0] if found else -1)
        at = found[0] + 1 if found else at
    return out


def test_block_maps_equal_a_plain_search():
    r = random.Random(3)
    for _ in range(200):
        lines = ["".join(r.choices("甲乙丙 丁\t", k=r.randint(0, 9))) for _ in range(r.randint(1, 5))]
        blocks = [r.randint(0, 30) for _ in lines]
        solid = [(c, b) for x, b in zip(lines, blocks) for c in x if not c.isspace()]
        source = "".join(c for c, _ in solid)
        wanted = "".join(r.choices("甲乙丙丁戊 ", k=r.randint(0, 12)))
        places = leftmost(source, "".join(wanted.split()))
        assert structure.char_owners("\n".join(lines), blocks, wanted) == [-1 if i < 0 else solid[i][1] for i in places]
        # Whole parts in order give the block of each part's first character.
        cuts = sorted(r.sample(range(len(source) + 1), min(3, len(source) + 1)))
        parts = [source[a:b] for a, b in zip([0, *cuts], [*cuts, len(source)])]
        owners, at, want = [b for _, b in solid], 0, []
        for p in parts:
            want.append(owners[at] if p else None)
            at += len(p)
        assert structure.first_blocks(parts, source, owners) == want
        assert structure.first_blocks(parts, source, None) == [None] * len(parts)
    assert structure.char_owners("甲\n乙", [1, 2, 3], "甲乙") == [-1, -1]
    assert structure.first_blocks(["戊甲", "甲"], "乙甲", [4, 5]) == [None, 5]


def test_graph_sections(spark):
    rows = spark.createDataFrame([(1, "before\n=== A ===\none\n=====\n===  ===\ntwo\n=== C ===\n \n", "t"), (2, " whole ", "t"), (3, " ", "t")], "id int, text string, title string")
    got = structure.graph_units(rows).orderBy("id", "unit").select("id", "unit", "unit_title", "body").collect()
    assert [tuple(r) for r in got][0][:3] == (1, 0, "A") and (2, 0, "t", "whole") in [tuple(r) for r in got] and not [r for r in got if r.id == 3]


def plain_alignment(zh, en):
    """The table filled cell by cell."""
    n, m = len(zh), len(en)
    zp, ep = [0, *itertools.accumulate(max(1, x) for x in zh)], [0, *itertools.accumulate(max(1, x) for x in en)]
    best, back = {(0, 0): 0.0}, {}
    for i, j in itertools.product(range(1, n + 1), range(1, m + 1)):
        for a, b in itertools.product(range(1, min(4, i) + 1), range(1, min(4, j) + 1)):
            if (i - a, j - b) in best:
                c = best[i - a, j - b] + abs(math.log((zp[i] - zp[i - a]) / (ep[j] - ep[j - b])) - math.log(zp[n] / ep[m])) + 0.05 * abs(zp[i] / zp[n] - ep[j] / ep[m]) + 0.4 * (a + b - 2)
                if c < best.get((i, j), math.inf):
                    best[i, j], back[i, j] = c, (i - a, j - b)
    if (n, m) not in best:
        return None
    out, at = [], (n, m)
    while at != (0, 0):
        out.append((back[at][0], at[0], back[at][1], at[1]))
        at = back[at]
    return out[::-1]


def test_alignment_equals_the_plain_table():
    r = random.Random(1)
    many = [[[r.randint(0, 90) for _ in range(r.randint(0, 14))] for _ in range(60)] for _ in range(2)]
    assert alignment.balanced(*many) == [plain_alignment(*x) if all(x) else None for x in zip(*many, strict=True)]
    for _ in range(20):
        zh, en = ([r.randint(1, 90) for _ in range(r.randint(1, 14))] for _ in range(2))
        assert alignment.balanced([zh], [en]) == [plain_alignment(zh, en)]
    for n, m in ((7, 9), (33, 20), (6, 24), (50, 51)):
        (got,) = alignment.balanced([[23] * n], [[77] * m])
        assert len(got) == min(n, m) and got[0][0] == got[0][2] == 0 and got[-1][1::2] == (n, m)
    assert alignment.balanced([[5] * 9, []], [[5] * 2, [1]]) == [None, None]


def test_tables_are_filled_in_parts(monkeypatch):
    r = random.Random(2)
    many = [[[r.randint(1, 60) for _ in range(r.randint(3, 9))] for _ in range(30)] for _ in range(2)]
    whole = alignment.balanced(*many)
    monkeypatch.setattr(alignment, "CELLS", 150)
    assert alignment.balanced(*many) == whole


def test_aligned_pairs(spark):
    rows = spark.createDataFrame([(1, ["甲乙丙。", "丁。"], ["A b c. ", "D."]), (2, ["甲。"] * 9, ["A."]), (3, [], ["x"])], "id int, zh array<string>, en array<string>")
    got = alignment.flag(alignment.align(rows, ["id"]), ["id"]).orderBy("id", "seq").collect()
    assert [(r.id, r.how, r.zh, r.en) for r in got] == [(1, "direct", "甲乙丙。", "A b c."), (1, "direct", "丁。", "D."), (2, "whole", " ".join(["甲。"] * 9), "A.")]
    assert got[2].needs_review and [tuple(r) for r in alignment.dropped(rows, ["id"]).collect()] == [(3, 0, 1)]


def test_gate(spark):
    good = [(1, i, "上海是中国最大的城市之一呀" + "很" * (i * 3), "Shanghai is one of the largest cities" + " so" * (i * 3), 1.0, False) for i in range(8)]
    swapped = [(2, i, e, z, c, n) for _, i, z, e, c, n in good]
    rows = spark.createDataFrame([*good, *swapped, (3, 0, "", "", 1.0, False)], "id int, seq int, zh string, en string, confidence double, needs_review boolean")
    got = {r.id: r for r in quality.gate(rows, ["id"], spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 0)], "id int, dropped_zh int")).collect()}
    assert (got[1].verdict, got[2].verdict, got[3].verdict, got[4].verdict) == ("ok", "rejected", "rejected", "rejected")
    assert got[2].issues[0] == "swapped" and got[4].issues == ["no_pairs"] and got[1].score == 1.0


def test_graph_answers(spark):
    answer = '```json\n{"categories":["甲"," 甲 ","",{"name":"乙"}],"knowledge_points":[{"name":"n0","summary":"s","quote":"原 文","weight":"3","category_index":1,"links":[{"index":1,"reason":"r"},{"index":2,"reason":"k"},{"index":2,"reason":"again"},{"index":0,"reason":"self"}]},{"name":"n1","summary":"s","quote":"不在"},{"name":"n2","summary":"s","quote":"原文，","category_index":9}]}\n```'
    units = spark.createDataFrame([(1, 0, "原文，更多", answer), (1, 1, "x", "no json")], "project int, unit int, body string, answer string")
    nodes = graph.checked_nodes(graph.answers_to_units(units), ["project", "unit"])
    got = nodes.orderBy("node").collect()
    assert [(r.name, r.weight, r.category) for r in got] == [("n0", 3, "乙"), ("n2", 2, "甲")]
    assert [[tuple(x) for x in r.links] for r in got] == [[(1, "k")], []]
    merged, categories = graph.merge(nodes, ["project"])
    assert [(r.category_key, r.name) for r in categories.orderBy("sort_order").collect()] == [("c000", "乙"), ("c001", "甲")]
    assert [tuple(r) for r in graph.edges(merged, ["project"], ["unit", "node"]).collect()] == [(1, "u000:n00", "u000:n01", "k")]


def test_odd_graph_answers(spark):
    answers = [
        '{"points":[{"name":7,"summary":null,"weight":"3","category_index":1.0,"links":[{"index":true,"reason":5},4,{"index":"1"}]},"x",{"weight":2.9,"category_index":0,"links":{}}],"categories":["a",{"name":"b"},{"x":1},3]}',
        'so ```json\n{"nodes":{},"items":[{}]}\n``` {', '{"nodes":[]} and {}', "[1]", "", None, '{"nodes":[{"name":"n"}],"points":[{"name":"p"}]}',
    ]
    rows = graph.answers_to_units(spark.createDataFrame(list(enumerate(answers)), "i int, answer string")).orderBy("i").collect()
    got = [(r.categories, [(n.raw, n["name"], n.summary, n.weight, n.category_index, [tuple(x) for x in n.links]) for n in r.nodes]) for r in rows]
    assert got == [(["a", "b", "", "3"], [(0, "7", "", 3, None, [(1, "5"), (None, "")]), (2, "", "", 2, 0, [])]), ([], [(0, "", "", 2, None, [])]), ([], []), ([], []), ([], []), ([], []), ([], [(0, "n", "", 2, None, [])])]


def test_sync_times_and_replay(spark):
    assert [str(x) for x in column(spark, ["2026-09-29T06:00:00.000Z", "2026-09-29T06:00:00", "2026-09-29T08:00:00+02:00"], sync.utc)] == ["2026-09-29 06:00:00"] * 3
    # An hour that the session's zone skips, and one that it has twice.
    times = ["2026-03-29T02:30:00", "2026-10-25T01:30:00Z", "2026-10-25T00:30:00Z", "2026-01-01T00:00:00.5-0530", "xZ", None]
    for zone in ("Europe/Berlin", "America/New_York", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        assert column(spark, times, lambda t: sync.utc(t).cast("string")) == ["2026-03-29 02:30:00", "2026-10-25 01:30:00", "2026-10-25 00:30:00", "2026-01-01 05:30:00.5", None, None]
    r = random.Random(2)
    ops = [(k, i, r.randint(0, 20)) for i, k in enumerate(r.choices(range(40), k=400))]
    first = {k: r.randint(0, 12) for k in range(35)}
    clock, want, now = 10, {}, dict(first)
    for k, i, t in sorted(ops, key=lambda o: (o[2], o[1])):
        want[i] = "skipped" if k not in now else "applied" if t >= now[k] else "conflict"
        now |= {k: clock} if want[i] == "applied" else {}
    df = spark.createDataFrame(ops, "key int, op_id int, client_ts int")
    done = sync.replay(df, spark.createDataFrame(list(first.items()), "key int, updated_at int"), ["key"], F.lit(clock), ["op_id"])
    assert {x.op_id: x.status for x in done.collect()} == want


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf" + "第一段\r\n\r\n second".encode())
    (tmp_path / "b.md").write_bytes("中文内容".encode("gb18030"))
    (tmp_path / "c.docx").write_bytes(b"x")
    got = D.read_text_files(spark, str(tmp_path)).orderBy("path", "block_no").collect()
    assert [r.text for r in got] == ["第一段", "second", "中文内容"]
    sessions = spark.createDataFrame([("s", 5, "x"), ("t", 0, "y")], "session_id string, size int, sha256 string")
    received = spark.createDataFrame([("s", 1, bytearray(b"cd"))], "session_id string, index int, data binary")
    assert {r.session_id: (r.missing, r.refusal) for r in D.completed(sessions, received, 2).collect()} == {"s": ([0, 2], "chunks"), "t": ([], "checksum")}


def test_paragraphs_of_pages(spark):
    assert D.plain_paragraphs([["A  b", "c"], ["zz"]], "noise\nA b\nc\nmore") == ["A b\nc", "zz"]
    # Blank lines are passed over, not taken; a line twelve ahead isn't found; repeated beginnings are found in turn.
    assert D.plain_paragraphs([["a b", "c  d"], ["e"]], "a b\n \nc d\ne") == ["a b\nc d", "e"]
    assert D.plain_paragraphs([["late"]], "\n".join(["x"] * 12 + ["late line"])) == ["late"]
    assert D.plain_paragraphs([["far"], ["no"]], "\n".join(["x"] * 11 + ["far"])) == ["far", "no"]
    assert D.plain_paragraphs([["s  1"], ["s  1"], ["s  1"]], "s 1\ns 1") == ["s 1", "s 1", "s  1"]
    assert D.plain_paragraphs([["x  y"]], "") == ["x  y"] and D.plain_paragraphs([], "x") == []
    # A paragraph found by its beginning takes lines up to its layout's length.
    assert D.plain_paragraphs([["0123456789012345678901234 more"]], "012345678901234567890123\n4mo\nre\nnext") == ["012345678901234567890123\n4mo\nre"]
    rows = spark.createDataFrame([("\n \na  b\nc\n\t\n\nd\n",), ("",), (" \n",), ("x",)], "t string")
    assert [r[0] for r in rows.select(page_groups(F.col("t"))).collect()] == [[["a  b", "c"], ["d"]], [], [], [["x"]]]


def test_jobs(spark):
    moves = spark.createDataFrame([("queued", "cancel"), ("success", "cancel"), ("failed", "resume"), ("running", "resume")], "status string, action string")
    assert [r[0] for r in moves.select(jobs.transition(F.col("status"), F.col("action"))).collect()] == ["cancelled", None, "queued", None]
    errors = spark.createDataFrame([(401, "x"), (403, "Access denied"), (429, "quota"), (429, "slow"), (500, ""), (404, "")], "s int, b string")
    assert [r[0] for r in errors.select(jobs.error_class(F.col("s"), F.col("b"))).collect()] == ["key_invalid", "bad_request", "quota_exceeded", "rate_limited", "provider_error", "bad_request"]


def test_client_patches(spark):
    ops = spark.createDataFrame([
        ("piece_progress", "1", '{"last_pos":3,"recited":true}', 1), ("piece_progress", "1", '{"last_pos":"x","recited":null,"z":1}', 2), ("piece_progress", "1", '{"last_pos":4.0}', 0), ("piece_progress", "9", '{"last_pos":4}', 0), ("piece_progress", "2", "no", 5),
        ("checkin", "2024-01-01", '{"items_json":["a",1]}', 1), ("checkin", "2024-01-02", '{"items_json":"x"}', 1), ("checkin", "2024-01-03", "{}", 1), ("checkin", "2024-01-03", "[1]", 2),
        ("plan", "1", '{"title":"t","new":{"a":[1]}}', 1), ("plan", "1", '{"title":null,"status":"s"}', 2), ("plan", "7", '{"title":"q"}', 2), ("goal", "1", '{"title":"g"}', 3), ("plan", "2", None, 3),
    ], "entity string, entity_id string, patch string, n int")
    pieces = spark.createDataFrame([(1, 0, False, "t"), (2, 5, True, "u")], "id int, last_pos int, recited boolean, title string")
    assert sorted(map(tuple, sync.patched_pieces(pieces, ops, ["n"]).collect())) == [(1, 3, True, "t"), (2, 5, True, "u")]
    days = spark.createDataFrame([("2024-01-01", ["old"], "2020-01-01"), ("2023-01-01", ["old"], "2020-01-01")], "date string, items array<string>, updated_at string")
    assert sorted(map(tuple, sync.patched_checkins(days, ops, ["n"], "2024-02-02").collect())) == [("2023-01-01", ["old"], "2020-01-01"), ("2024-01-01", ["a", "1"], "2024-02-02"), ("2024-01-02", [], "2024-02-02"), ("2024-01-03", [], "2024-02-02")]
    plans = spark.createDataFrame([(1, {"title": '"o"', "due": '"d"'}), (2, {"title": '"o"'})], "id int, row map<string,string>")
    assert sorted((r.id, sorted(r.row.items())) for r in sync.patched_plans(plans, ops, ["n"]).collect()) == [(1, [("due", '"d"'), ("new", '{"a":[1]}'), ("status", '"s"'), ("title", "null")]), (2, [("title", '"o"')])]


def test_forms_of_headings(spark):
    """Closings before headings, zones, marks that are trimmed, lines that inherit a language."""
    lines = [
        "（一）东湖景区主要景点：塔、桥", "（2）这是一个很长的地方名字用来超过二十个字的说明介绍", "（3）短地讲解（2 题）。", "（4）短地介绍", "范文（三）", "范文 12 ", "说完了，谢谢大家！范文（四）", "Bye. Thank you all!（五）西湖风景区景点", "谢谢大家！再见范文（六）", "范文（七）谢谢大家！范文（八）",
    ]
    blocks = spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(lines)], "d int, block_no int, page int, text string")
    got = [(r.block_no, r.kind, r.title) for r in structure.scan(blocks, ["d"]).orderBy("n").collect()]
    assert got == [
        (0, "area", "东湖"), (1, "area", "这是一个很长的地方名字用来超过二十个字的说明"), (2, "area", "短地"), (3, "area", "短地"), (4, "piece", "三"), (5, "piece", "12"), (6, "body", None), (6, "piece", "四"), (7, "body", None), (7, "area", "西湖"), (8, "note", None), (9, "note", None), (9, "piece", "八"),
    ]
    trims = ["亲爱的游客朋友们，谢谢大家！我们走。", " Thank you all! 。，— hi ", "hello. Thank you all.", "谢谢大家！", "DEAR TOURISTS AND FRIENDS, go"]
    assert column(spark, trims, structure.trim_markers) == ["谢谢大家！我们走。", "hi", "hello. Thank you all.", "", "go"]
    body = ["范文（一）", "中文的一行。", "mostly English with 中文字 in it here", "plain English", "also 中文 in this longer English line", "全是中文"]
    runs = structure.language_runs(structure.scan(spark.createDataFrame([(1, i, 0, t) for i, t in enumerate(body)], "d int, block_no int, page int, text string"), ["d"]), ["d"])
    assert [(r.run, r.lang, list(r.line_blocks)) for r in runs.orderBy("run").collect()] == [(0, "zh", [1, 2]), (1, "en", [3, 4]), (2, "zh", [5])]
