"""Base rules by hand, distances by their definition, accuracy on labelled rows, and the query against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from studyloom.llm import oracles
from studyloom.llm import quality_rules as q
from studyloom.llm.queries import op12_quality_rules
from studyloom.session import table

from .conftest import odd_rows, prose, table_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    fives = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if fives[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def test_base_rules_and_odd_rows(spark, odd, empty):
    common = q.common_words(odd)
    counted = q.with_counts(odd, common, keep=["doc_id", "text"])
    got = sorted(map(repr, ((r.row.doc_id, r.row.text, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in counted.collect())))
    assert got == sorted(repr((r[0], r[1], *base(r[1]))) for r in odd_rows())
    judged = q.judge(odd, keep=["doc_id"])
    assert judged.count() == len(odd_rows()) and judged.where("base_failed and kept").count() == 0
    assert q.judge(empty).count() == 0
    wide = odd.withColumnsRenamed({"n_chars": "kept"}).withColumn("n_words", F.lit(1)).withColumn("chars", F.lit("x"))
    assert set(wide.columns) <= set(q.judge(wide).select("row.*").columns)


def test_repeats_stay_inside_a_text():
    r = random.Random(1)
    for _ in range(200):
        texts = [[r.choice("ab") for _ in range(r.randint(0, 12))] for _ in range(3)]
        ids = np.array([ord(w) for t in texts for w in t], np.int64)
        owner = np.repeat(np.arange(3), [len(t) for t in texts])
        hit = q.repeated_places(ids, owner)
        assert [int(hit[owner == i].sum()) for i in range(3)] == [base(" ".join(t))[4] for t in texts]


def test_distances():
    def plain(x, y):
        p, m = [v / max(1, sum(x)) for v in x], None
        m = [(a + b) / 2 for a, b in zip(p, y, strict=True)]
        kl = lambda u: sum(a * math.log2(a / b) for a, b in zip(u, m, strict=True) if a > 0)
        return math.sqrt(max(0, (kl(p) + kl(y)) / 2)) if sum(x) else 0

    ref = np.array([0.5, 0.25, 0.25, 0.0])
    rows = np.array([[2, 1, 1, 0], [0, 0, 0, 9], [1, 0, 0, 0], [0, 0, 0, 0]])
    got = q.distances(rows, ref)
    assert np.allclose(got, [plain(x, ref) for x in rows.tolist()]) and got[0] == 0 and abs(got[1] - 1) < 1e-12


def test_languages(spark):
    """A text of another language is far from its own reference; unnamed ones go to the nearest; unknown names too."""
    other = lambda seed, n: prose(seed, n)[::-1]
    rows = [(i, prose(i, 200), "aa") for i in range(30)] + [(100 + i, other(i, 200), "bb") for i in range(30)]
    rows += [(200, other(99, 300), "aa"), (201, other(99, 300), None), (202, prose(98, 300), None), (203, prose(97, 300).upper(), "aa"), (204, " ".join(f"{w}&&&" for w in prose(96, 300).split()), None), (205, prose(95, 300), "aa")]
    got = {r.row.doc_id: r for r in q.judge(table_of(spark, rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in (*range(30), *range(100, 130), 201, 202, 205))
    assert not any(got[i].kept for i in (200, 203, 204))
    assert got[201].word_distance < got[200].word_distance


def test_labelled_rows(spark):
    """Of rows that pass the base rules nearly all clean ones stay and nearly all junk goes."""
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality")
    rows = op12_quality_rules(spark, sf).join(labels, F.col("doc_id") == F.col("id")).where("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.995
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.95


def test_query_equals_sql(spark, small, sql_rows):
    df = op12_quality_rules(spark, small)
    assert sql_rows(df) == sql_rows(oracles.QUALITY)
