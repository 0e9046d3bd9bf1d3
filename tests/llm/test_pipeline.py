"""The stages one after the other, held against what each has to leave over."""

from __future__ import annotations

import os
from itertools import combinations

from pyspark.sql import functions as F

import corpus_pipeline
from studyloom.llm import simhash, toxicity
from studyloom.llm.common import written
from studyloom.session import table

from .conftest import prose, table_of
from .test_decontam import brute
from .test_passages import left


def texts_of(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def heads(docs, words=5, least=0.8):
    """The smallest id of each class of texts whose sets of five-word shingles are similar, over all pairs."""
    sets = {}
    for d, t in docs.items():
        own = (t or "").encode().translate(simhash._SPLIT).split()
        sets[d] = frozenset(tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))) if own else frozenset()
    root = {d: d for d in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(docs), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= least * max(len(x), len(y)) and (x == y or len(x & y) >= least * len(x | y)):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {d for d in docs if find(d) == d}


def test_stages_on_the_smallest_table(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "substring dedup", "decontamination", "packing"]
    docs = table(spark, small, "documents")
    columns, seen = docs.columns, [texts_of(docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), f"test-{name.replace(' ', '-')}")
        if name != "packing":
            assert docs.columns == columns
            seen.append(texts_of(docs))
    everything, clean, single, cut, last = seen
    scores = toxicity.with_scores(table(spark, small, "documents"), toxicity.fit(table(spark, small, "documents"), table(spark, small, "labels")), keep=["doc_id"])
    assert set(clean) == {r.doc_id for r in scores.where(F.col("score") < 0.7).collect()}
    assert set(single) == heads(clean)
    assert set(cut) == set(single) and list(map(cut.get, sorted(cut))) == left([single[d] for d in sorted(single)])
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    hits = {d: (n, hit) for d, n, hit, *_ in brute(list(cut.items()), items)}
    assert set(last) == {d for d, (n, hit) in hits.items() if hit <= 0.5 * n}
    assert all(last[d] == cut[d] for d in last if not hits[d][1])
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(last)


def test_odd_tables(spark, small, odd, empty):
    for docs in (odd.withColumn("fp", F.lit(1)).withColumn("_head", F.lit("x")), empty):
        rows = docs
        for _, stage in corpus_pipeline.STAGES:
            rows = written(stage(spark, rows, small), "test-odd")
        assert (rows.count() > 0) == (docs.count() > 0)


def test_a_very_long_text(spark, small):
    long = prose(77, 400_000)
    docs = table_of(spark, [(1, long, "en", "s", 1), (2, f"{long[:3000]} other", "en", "s", 1), (3, "short", "en", "s", 1)])
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), "test-long")
    assert {r.doc_id for r in docs.collect()} == {1, 2, 3}


def test_what_stages_write_goes(spark, small, tmp_path):
    base = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(base.removeprefix("file://")))
    docs = corpus_pipeline.run(spark, small)
    rows = docs.count()
    assert rows and len(set(os.listdir(base.removeprefix("file://"))) - before) == 1 and docs.count() == rows
