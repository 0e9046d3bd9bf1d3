"""Brute force: every window of every item against every place of every document."""

from __future__ import annotations

import hashlib
import re

from studyloom.llm import decontam
from studyloom.llm.queries import op1_decontaminate
from studyloom.session import table

from .conftest import odd_rows, prose, table_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1)) if w else []:
            windows.setdefault(tuple(w[i : i + window]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if names := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text").collect()
    items = table(spark, small, "benchmark").select("item_id", "text").collect()
    assert got(op1_decontaminate(spark, small)) == brute(docs, items)


ITEMS = [(1, prose(1, 40)), (2, "river cloud"), (3, "cloud"), (4, prose(3, 10)), (5, prose(3, 10)), (6, None), (7, " . "), (8, "red green blue red green blue red green blue red green blue"), (None, prose(4, 30))]


def test_odd_texts_short_items_and_blocks(spark, odd, empty):
    bench = table_of(spark, ITEMS, "item_id long, text string")
    docs = [(r[0], r[1]) for r in odd_rows()]
    named = [(i, t) for i, t in ITEMS if i is not None]
    for block in (1 << 20, 30):
        hits = decontam.find_contamination(odd, bench.where("item_id is not null"), keep=["doc_id"], block_words=block)
        result = sorted(((r.doc_id, r.n_words, sum(e - s for s, e in zip(r.hit_spans[::2], r.hit_spans[1::2], strict=True)), len(r.item_ids)) for r in hits.collect()), key=str)
        assert result == sorted((b[:4] for b in brute(docs, named)), key=str)
    assert decontam.find_contamination(empty, bench).count() == 0
    assert decontam.find_contamination(odd, bench.limit(0)).where("size(item_ids) > 0").count() == 0
    assert decontam.find_contamination(odd, bench).count() == odd.count()


def test_removal_keeps_clean_texts(spark):
    passage = prose(5, 20)
    clean, mixed = prose(6, 50), f"{prose(7, 60)}. {passage}! {prose(8, 60)}"
    docs = table_of(spark, [(1, clean, "en", "s", 1), (2, mixed, "en", "s", 1), (3, passage, "en", "s", 1), (4, None, None, None, None)]).withColumnRenamed("n_chars", "hit_spans")
    left = {r.doc_id: r.text for r in decontam.decontaminate(docs, table_of(spark, [(1, passage)], "item_id long, text string")).collect()}
    assert left == {1: clean, 2: mixed.replace(passage, ""), 4: None}


def test_many_passes_equal_one(spark, small):
    """Blocks smaller than items, so that items come in pieces and documents are hit in several passes."""
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    one, many = (decontam.find_contamination(docs, bench, keep=["doc_id", "source"], block_words=n) for n in (1 << 20, 500))
    want = sorted(map(str, one.collect()))
    assert sorted(map(str, many.collect())) == want and sum("hit_spans=[]" not in r for r in want) > 2


def test_a_long_item_in_several_automata():
    words = [w.encode() for w in prose(11, 3000).split()]
    block = decontam.ItemBlock([("a", words[:1200]), ("b", words[1191:2100]), ("c", words[2091:])], part=500)
    assert len(block.automata) == 3
    hit, names = block.search(words)
    assert hit.all() and names == ["a", "b", "c"]
