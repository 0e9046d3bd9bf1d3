"""Exact similarity of all pairs, and union-find over them."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from studyloom.llm import near_copies, simhash

from .conftest import prose, table_of


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def heads(docs):
    """The smallest id of each class."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {find(d) for d in sets}


def edited(text, *places):
    words = text.split()
    for p in places:
        words[p % len(words)] = f"edit{p}"
    return " ".join(words)


def stage(spark, docs, small):
    out = dict(corpus_pipeline.STAGES)["simhash"](spark, docs, small)
    assert out.columns == docs.columns
    return {r.doc_id for r in out.collect()}


def test_edited_copies_go(spark, small):
    docs = []
    for i in range(20):
        text = prose(200 + i, 60 + 15 * i)
        n = len(text.split())
        # Each edit changes five shingles: similar by over 0.8, and well below.
        docs += [(3 * i, text), (3 * i + 1, edited(text, *range(7, n, 80))), (3 * i + 2, edited(text, *range(3, n, 12)))]
    far = [(simhash.fingerprint_of(a.encode()) ^ simhash.fingerprint_of(b.encode())).bit_count() for (_, a), (_, b) in zip(docs[::3], docs[1::3], strict=True)]
    assert sum(x > 2 for x in far) > 10
    assert stage(spark, table_of(spark, [(d, t, "en", "s", 1) for d, t in docs]).withColumn("fp", F.lit(1)), small) == heads(docs)


def test_a_class_larger_than_a_bucket(spark, small):
    text = prose(300, 160)
    docs = [(i, edited(text, *(7 * i + 31 * j for j in range(i % 5)))) for i in range(90)]
    docs += [(100 + i, prose(400 + i, 90)) for i in range(20)]
    assert max(len(docs) - 20, 0) > near_copies.SMALL
    assert stage(spark, table_of(spark, [(d, t, "en", "s", 1) for d, t in docs]).repartition(3), small) == heads(docs)


def test_pages_of_one_template(spark, small):
    """Pages of one template are similar by 0.754; pairs among them by 0.802 share three words more."""
    template = prose(500, 90)
    own = lambda seed, n: " ".join(f"{w}{seed}" for w in prose(seed, n).split())
    docs = [(i, f"{template} {own(600 + i, 14)}") for i in range(300)]
    for i in range(60):
        common = own(2000 + i, 3)
        docs += [(1000 + 2 * i + k, f"{template} {common} {own(3000 + 2 * i + k, 11)}") for k in range(2)]
    x, y, z = (shingles(docs[i][1]) for i in (0, 300, 301))
    assert round(len(x & y) / len(x | y), 3) == 0.754 and round(len(y & z) / len(y | z), 4) == 0.8018
    kept = stage(spark, table_of(spark, [(d, t, "en", "s", 1) for d, t in docs]).repartition(3), small)
    assert len(kept) == 360 and kept == {*range(300), *range(1000, 1120, 2)}


def test_few_of_many_that_share_common_shingles_only(spark, small):
    """Four pages with ten words of their own are similar by 0.811, all others (twelve words) by less than 0.8; whatever they
    share, all 204 share."""
    template = prose(510, 90)
    own = lambda seed, n: " ".join(f"{w}{seed}" for w in prose(seed, n).split())
    docs = [(i, f"{template} {own(5000 + i, 10 if i % 51 == 17 else 12)}") for i in range(204)]
    wanted = heads(docs)
    assert len(wanted) == 201
    assert stage(spark, table_of(spark, [(d, t, "en", "s", 1) for d, t in docs]).repartition(3), small) == wanted


def test_signatures_rule_out_no_similar_pair():
    import numpy as np

    rng = np.random.default_rng(7)
    for n in (1, 5, 40, 300, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        y = np.unique(np.concatenate([x[len(x) // 9 :], rng.integers(0, 1 << 63, len(x) // 9).astype(np.uint64)]))
        apart = len(np.setxor1d(x, y))
        bits = sum((a ^ b).bit_count() for a, b in zip(near_copies.signature(x), near_copies.signature(y), strict=True))
        assert near_copies.similarity(x, y) >= 0.8 and bits <= apart and 9 * apart <= len(x) + len(y)


def test_null_ids_ties_and_names(spark):
    text = prose(700, 50)
    rows = [(None, text, "a", 1, 2), (5, text, "a", 1, 2), (5, text, "b", 1, 2), (None, prose(701, 50), "a", 1, 2), (None, None, None, None, None), (7, "", "x", 1, 2), (7, edited(prose(702, 200), 50), "x", 1, 2), (8, prose(702, 200), "x", 1, 2)]
    df = table_of(spark, rows, "doc_id long, text string, row string, rid long, id int").withColumns({"node": F.lit(1), "bands": F.lit("b"), "size": F.lit(0), "key": F.lit(0)})
    got = near_copies.drop_near_copies(df.repartition(2))
    assert got.columns == df.columns
    # The smallest id stays, null last; of one id and text, one row.
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(5, text), (None, prose(701, 50)), (7, ""), (7, edited(prose(702, 200), 50))], key=repr)
    assert near_copies.drop_near_copies(df.where("false")).count() == 0


def test_places_rule_out_pages_of_one_template(spark, small, monkeypatch):
    """Pages that share all but 28 of 186 shingles have more of their own first than a similar pair may: none of them meets another,
    however many there are, and the two that are similar do."""
    met, rest = [], near_copies._rest
    monkeypatch.setattr(near_copies, "_rest", lambda *a: met.append(n := rest(*a)) or n)
    # Signatures that rule nothing out.
    monkeypatch.setattr(near_copies, "signature", lambda hashes: bytes(256))
    template = prose(520, 190)
    own = lambda seed, n: " ".join(f"{w}{seed}" for w in prose(seed, n).split())
    docs = [(i, f"{template} {own(7000 + i, 12 if i < 2 else 40)}") for i in range(200)]
    assert stage(spark, table_of(spark, [(d, t, "en", "s", 1) for d, t in docs]).repartition(3), small) == heads(docs) == {0, *range(2, 200)}
    assert all(m is None or m.count() <= 200 for m in met)
