"""Brute force: every string of the length in a dictionary of all places."""

from __future__ import annotations

import hashlib
from collections import Counter

from pyspark.sql import functions as F

from studyloom.llm import substring_dedup as sd
from studyloom.llm.queries import op7_substring_dedup
from studyloom.session import table

from .conftest import odd_rows, prose, table_of


def brute(docs, length=400):
    data = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(x[i : i + length] for _, x in data for i in range(len(x) - length + 1))
    out = []
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((d, len(x), len(x) - len(kept), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passage_words(docs, words=51):
    """Words in passages of so many words that also begin anywhere else."""
    lists = [(t or "").encode().split() for _, t in docs]
    seen = Counter(tuple(x[i : i + words]) for x in lists for i in range(len(x) - words + 1))
    out = []
    for (d, _), x in zip(docs, lists, strict=True):
        gone = set()
        for i in range(len(x) - words + 1):
            if seen[tuple(x[i : i + words])] > 1:
                gone.update(range(i, i + words))
        out.append((d, len(gone)))
    return sorted(out)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    found = op7_substring_dedup(spark, small)
    assert got(found.drop("n_passage_words")) == brute(docs)
    assert sorted((r.doc_id, r.n_passage_words) for r in found.collect()) == passage_words(docs)


def test_odd_texts_at_small_lengths_and_limits(spark, odd, empty):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for length, k, limit in ((400, 48, 256), (60, 8, 256), (60, 8, 1), (20, 4, 8)):
        found = sd.repeated_spans(odd.withColumn("spans", F.lit(1)), length=length, k=k, group_limit=limit)
        assert got(sd.digest_kept(found, ["doc_id"])) == brute(rows, length)
    assert sd.repeated_spans(empty).count() == 0


def test_partial_overlaps(spark):
    common = prose(20, 300)
    rows = [(i, f"{prose(30 + i, 50 + i)} {common[7 * i : 900 + 11 * i]} {prose(60 + i // 2, 40)}", "en", "s", 1) for i in range(30)]
    rows += [(100, "abc" * 900 + common[:500], "en", "s", 1), (101, "z" * 3000, "en", "s", 1), (102, "y" * 400, "en", "s", 1), (103, "w" * 401, "en", "s", 1)]
    docs = table_of(spark, rows).repartition(5)
    for length, limit in ((400, 256), (150, 256), (150, 3), (60, 1)):
        found = sd.repeated_spans(docs, length=length, k=min(48, length // 5), group_limit=limit)
        assert got(sd.digest_kept(found, ["doc_id"])) == brute([(r[0], r[1]) for r in rows], length)


def test_texts_left_are_valid(spark):
    common = "é" * 300
    docs = table_of(spark, [(1, f"x{common}ü", "en", "s", 1), (2, f"yy{common}", "en", "s", 1), (3, "untouched", None, None, None), (4, None, None, None, None)])
    left = {r.doc_id: r.text for r in sd.drop_repeats(docs).collect()}
    assert left[3] == "untouched" and left[4] is None and set(left) == {1, 2, 3, 4}
