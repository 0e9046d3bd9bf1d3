"""Quotes in sources against all pairs."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.functions import text as X
from studyloom.operators import quotes


def plain(spark, sources, wanted):
    a, b = spark.createDataFrame(sources, "s int, text string"), spark.createDataFrame(wanted, "q int, quote string")
    both = a.join(b, X.in_source(F.col("quote"), F.col("text")) & ~X.is_blank(F.col("quote")))
    return sorted((r.s, r.q) for r in both.select("s", "q").collect())


def joined(spark, sources, wanted):
    a, b = spark.createDataFrame(sources, "s int, text string"), spark.createDataFrame(wanted, "q int, text string")
    return sorted((r.s, r.q) for r in quotes.standing(a, b, "s", "q").collect())


def test_against_all_pairs(spark):
    r = random.Random(4)
    letters = "abc 江湖。，. …"
    sources = [(i, "".join(r.choice(letters) for _ in range(r.randrange(0, 120)))) for i in range(40)]
    wanted = []
    for q in range(120):
        source = r.choice(sources)[1]
        at, n = r.randrange(len(source) + 1), r.choice([1, 2, 3, 5, 8, 13, 14, 15, 16, 30, 60])
        cut = source[at : at + n]
        wanted.append((q, cut.replace("。", ".") if q % 3 == 0 else " ".join(cut) if q % 3 == 1 else cut[: n // 2] + "x" + cut[n // 2 :]))
    sources += [(100, None), (101, ""), (0, sources[0][1])]
    wanted += [(200, None), (201, " 　"), (202, "..."), (203, "…"), wanted[0]]
    want = plain(spark, sources, wanted)
    assert joined(spark, sources, wanted) == want and len(want) > 200


def test_no_rows(spark):
    assert joined(spark, [], [(1, "a")]) == [] and joined(spark, [(1, "a")], []) == []


def test_a_quote_keeps_what_its_source_keeps():
    r = random.Random(5)
    for _ in range(200):
        text = bytes(r.randrange(97, 100) for _ in range(r.randrange(15, 80)))
        n = r.randrange(15, len(text) + 1)
        at = r.randrange(len(text) - n + 1)
        own, whole = quotes.kept_grams(text[at : at + n], 0), quotes.kept_grams(text, 0)
        assert len(own) and np.isin(own, whole).all()
        assert np.isin(quotes.kept_grams(text[3:7], 4), quotes.kept_grams(text, 4)).all()
