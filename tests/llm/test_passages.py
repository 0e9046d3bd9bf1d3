"""Brute force over all strings of words, beside that over strings of bytes."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline

from .conftest import odd_rows, prose, table_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def left(docs, words=51, length=400):
    data = [(t or "").encode() for t in docs]
    lists = [[(m.start(), m.end(), m[0]) for m in WORD.finditer(x)] for x in data]
    runs = Counter(tuple(w[2] for w in ws[i : i + words]) for ws in lists for i in range(len(ws) - words + 1))
    strings = Counter(x[i : i + length] for x in data for i in range(len(x) - length + 1))
    out = []
    for x, ws in zip(data, lists, strict=True):
        gone = bytearray(len(x))
        for i in range(len(ws) - words + 1):
            if runs[tuple(w[2] for w in ws[i : i + words])] > 1:
                s, e = ws[i][0], ws[i + words - 1][1]
                gone[s:e] = b"\1" * (e - s)
        for i in range(len(x) - length + 1):
            if strings[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def stage(spark, docs, small):
    out = dict(corpus_pipeline.STAGES)["substring dedup"](spark, docs, small)
    assert out.columns == docs.columns
    return out.collect()


def test_passages_of_51_short_words_go(spark, small):
    short = " ".join(f"{chr(97 + i % 26)}{i // 26}" for i in range(51))
    near = " ".join(short.replace("a", "é").split()[:50])
    docs = [f"{prose(500, 30)} {short} {prose(501, 20)}", f"{prose(502, 70)}\n{short.replace(' ', '  ')}", f"{prose(503, 40)} {near} x", f"{prose(504, 40)} {near} y", "a " * 200, "漢" * 300, f"x {'漢' * 300}"]
    assert len(short.encode()) < 400
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(docs)]
    got = {r.doc_id: r.text for r in stage(spark, table_of(spark, rows).repartition(3), small)}
    assert got == dict(enumerate(left(docs)))
    assert got[0] == f"{prose(500, 30)}  {prose(501, 20)}" and got[1] == f"{prose(502, 70)}\n" and got[2] == docs[2]


def test_odd_rows(spark, small, odd):
    rows = odd_rows()
    want = Counter((r[0], r[1] if r[1] is None else t) for r, t in zip(rows, left([r[1] for r in rows]), strict=True))
    assert Counter((r.doc_id, r.text) for r in stage(spark, odd, small)) == want
