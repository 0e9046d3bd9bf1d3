"""Brute force over all pairs of fingerprints, and union-find over them."""

from __future__ import annotations

import random
import re

import xxhash
from pyspark.sql import functions as F

from studyloom.llm import simhash
from studyloom.llm.queries import op2_simhash
from studyloom.session import table

from .conftest import odd_rows, prose, table_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    w = WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))
    grams = [w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else [])
    h = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints):
    """(id, fingerprint) to {id: smallest id}."""
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    values = sorted({f for _, f in prints})
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[find(a)] = find(b)
    low = {}
    for d, f in prints:
        low[find(f)] = min(low.get(find(f), d), d)
    return {d: low[find(f)] for d, f in prints}


def test_query_equals_brute_force(spark, small):
    prints = [(r.doc_id, fingerprint(r.text)) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = classes(prints)
    assert sorted(map(tuple, op2_simhash(spark, small).collect())) == sorted((d, f"{f:016x}", want[d]) for d, f in prints)


def test_classes_of_chains_and_crowded_buckets(spark):
    r = random.Random(3)
    base = r.getrandbits(64)
    values = {base ^ (1 << a) ^ (1 << b) for a in range(0, 64, 5) for b in range(0, 64, 7)} | {r.getrandbits(64) for _ in range(200)}
    chain = r.getrandbits(64)
    for b in range(0, 40, 2):
        chain ^= 3 << b
        values.add(chain)
    prints = list(enumerate(values))
    want = classes(prints)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in values], "fp long")
    for limit in (256, 1):
        links = simhash.links(df, bucket_limit=limit)
        roots = {r.node: r.root for r in simhash.components(links).collect()}
        groups, wanted = {}, {}
        for i, f in prints:
            s = f - (1 << 64) if f >> 63 else f
            groups.setdefault(roots.get(s, s), set()).add(i)
            wanted.setdefault(want[i], set()).add(i)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_odd_texts(spark, odd, empty):
    got = simhash.near_duplicate_classes(odd)
    rows = [(r[0], fingerprint(r[1])) for r in odd_rows()]
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in got.collect()), key=str) == sorted(rows, key=str)
    zero = {r.component_id for r in got.where("fp = 0").collect()}
    assert zero == {3}
    assert simhash.near_duplicate_classes(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert simhash.drop_near_duplicates(empty).count() == 0


def test_copies_beyond_the_smallest_go(spark):
    text = prose(9, 400)
    docs = table_of(spark, [(i, text if i % 2 else prose(100 + i, 300), "en", "s", i) for i in range(10)]).withColumn("fp", F.lit(1))
    assert sorted(r.doc_id for r in simhash.drop_near_duplicates(docs).collect()) == [0, 1, 2, 4, 6, 8]
