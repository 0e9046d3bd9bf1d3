"""All pairs by hand, pruning by norms, blocks of anchors, and the query against its SQL."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from studyloom.llm import hard_negatives as hn
from studyloom.llm import oracles
from studyloom.llm.queries import op13_hard_negatives

from .conftest import table_of

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, scale=256, k=5, m=5):
    known = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (label, [math.floor(scale * float(np.float32(x))) for x in v])
        known[i] = min(known.get(i, own), own)
    dims = max((len(v) for _, v in known.values()), default=0)
    full = {i: (label, [*v, *[0] * (dims - len(v))]) for i, (label, v) in known.items()}
    out = []
    for a, (label, v) in full.items():
        if a % 10:
            continue
        scores = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in full.items() if i != a))
        for s, p, _ in [x for x in scores if x[2] == label][:k]:
            fit = [(n, t) for t, n, other in scores if other != label and 80 * -s <= 100 * -t <= 100 * -s][:m]
            out += [(a, p, rank, n, -s, -t) for rank, (n, t) in enumerate(fit, 1)]
    return sorted(out)


def mined(df):
    got = hn.mine(df, F.col("id") % 10 == 0)
    return sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


def vectors(seed, n, dims=6, spread=0.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0.3, 0.4) * math.exp(spread * r.gauss(0, 1)) for _ in range(dims)], r.randrange(3)) for i in range(n)]


def test_against_all_pairs(spark):
    for spread in (0.0, 1.5):
        rows = vectors(1, 160, spread=spread)
        got = mined(table_of(spark, rows, SCHEMA).repartition(3))
        assert got == plain(rows) and got


def test_small_buckets_and_blocks(spark, monkeypatch):
    rows = vectors(2, 150, spread=1.0) + [(i + 500, [0.25, 0.25, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(40)]
    want = plain(rows)
    monkeypatch.setattr(hn, "BUCKET", 7)
    monkeypatch.setattr(hn, "SLICE", 3)
    monkeypatch.setattr(hn, "ANCHORS", 4)
    assert mined(table_of(spark, rows, SCHEMA).repartition(2)) == want


def test_odd_rows(spark):
    rows = vectors(3, 60) + [(70, None, 1), (80, [1.0, None], 1), (90, [float("nan")], 1), (100, [float("inf")], 0), (110, [0.5] * 6, None), (None, [0.5] * 6, 1), (120, [], 1), (130, [0.5], 2), (140, [0.1] * 9, 0)]
    rows += [rows[0], rows[7], (7, [9.0] * 6, 0), (150, [0.0] * 6, 1), (160, [-5.0] * 6, 1)]
    assert mined(table_of(spark, rows, SCHEMA)) == plain(rows)
    assert mined(table_of(spark, [], SCHEMA)) == [] and mined(table_of(spark, [(1, [1.0], 1)], SCHEMA)) == [] and mined(table_of(spark, [(0, [1.0], 1)], SCHEMA)) == []
    wide = table_of(spark, [(*r, "x", 1.0) for r in vectors(4, 40)], SCHEMA + ", id string, norm2 double")
    assert mined(wide) == plain(vectors(4, 40))


def test_numbers_beyond_53_bits(spark):
    r = random.Random(5)
    rows = [(i, [r.randrange(1 << 21) + 0.5 for _ in range(4)], i % 2) for i in range(30)]
    assert mined(table_of(spark, rows, SCHEMA)) == plain(rows)


def test_buckets_out_of_reach_are_passed_over(monkeypatch):
    """Once a window is full, a bucket of short rows isn't multiplied."""
    block = {"id": np.array([0]), "label": np.array([1]), "norm2": np.array([4.0]), "v": np.array([[2, 0]])}
    windows = hn.Windows(np.array([0]), np.array([-(1 << 62)]), np.array([1 << 62]), 2)
    hn.search(block, windows, np.array([5, 6, 7]), np.array([1, 1, 2]), np.array([[9, 0], [8, 0], [7, 0]]), np.array([81.0, 64.0, 49.0]), True)
    assert windows.found()[1].tolist() == [18, 16] and windows.floor.tolist() == [16]
    assert hn.reachable(block["norm2"], windows.floor, 64.0).all() and not hn.reachable(block["norm2"], windows.floor, 63.0).any()
    # Equal scores enter by the smaller id.
    hn.search(block, windows, np.array([4]), np.array([1]), np.array([[8, 0]]), np.array([64.0]), True)
    assert windows.found()[2].tolist() == [5, 4]


def test_query_equals_sql(spark, small, sql_rows):
    df = op13_hard_negatives(spark, small)
    assert sql_rows(df) == sql_rows(oracles.HARD_NEGATIVES) and df.count()
