"""Brute force over all pairs of words, and the query against its SQL."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from studyloom.llm import oracles, spelling
from studyloom.llm.queries import op11_spelling_variants

from .conftest import odd_rows, table_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows, every=31):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            if every and doc_id is not None and (h := zlib.crc32(f"{doc_id}:{run}".encode())) % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(known):
    known = {w: n for w, n in known.items() if n >= 2}
    near_of = {w: [x for x in known if near(w, x)] for w in known}
    form = {w: min(xs, key=lambda x: (-known[x], x)) if xs else None for w, xs in near_of.items()}
    form = {w: f if f and known[f] >= 10 * known[w] else None for w, f in form.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, n, len(near_of[w]), form[w], form[w] and known[form[w]], root(w)) for w, n in known.items())


def test_against_all_pairs(spark):
    r = random.Random(3)
    base = ["".join(r.choice("abcé") for _ in range(8)) for _ in range(12)]
    weights = [500, 40, 3] * 4
    texts = []
    for doc in range(40):
        words = r.choices(base, weights, k=60)
        for i in range(0, 60, 7):
            w, at = words[i], r.randrange(8)
            words[i] = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abcé") + w[at:], w[:at] + r.choice("abÿ") + w[at + 1 :]])
        texts.append((doc, " ".join(x.upper() if i % 9 == 0 else x for i, x in enumerate(words))))
    # A chain: each word ten times as common as the one before it, and one letter off.
    chain = [("chainaaa", 2), ("chainaab", 20), ("chainabb", 200), ("chainabbx", 2000)]
    texts.append((None, " ".join(w for w, n in chain for _ in range(n))))
    rows = table_of(spark, texts, "doc_id long, text string").repartition(3)
    got = spelling.variants(spelling.word_counts(rows, misspelt_every=31)).collect()
    assert sorted(map(tuple, got)) == plain(counts(texts))
    by = {r.word: r for r in got}
    assert by["chainaaa"].root == "chainabbx" and by["chainaaa"].form == "chainaab" and by["chainabbx"].form is None


def test_without_misspellings_and_short_words(spark):
    rows = table_of(spark, [(1, "abc abd abc abd ab ab x x")], "doc_id long, text string")
    got = spelling.variants(spelling.word_counts(rows, min_length=2), form_times=10).collect()
    assert {r.word: r.n_near for r in got} == {"ab": 2, "abc": 2, "abd": 2}


def test_keys_are_of_distinct_deletions():
    words = ["aabbb", "abab", "\U0001f600x", "a"]
    place, key = spelling.deletion_keys(words)
    strings = [[w, *dict.fromkeys(w[:i] + w[i + 1 :] for i in range(len(w)))] for w in words]
    assert [sum(place == i) for i in range(4)] == [len(s) for s in strings]
    # Equal strings have equal keys wherever they come from.
    assert spelling.deletion_keys(["abbb"])[1][0] in key[place == 0] and spelling.deletion_keys(["aabb"])[1][0] in key[place == 0]
    assert len({int(k) for k, p in zip(key, place, strict=True) if p == 1}) == 5


def test_odd_rows(spark, odd, empty):
    rows = odd_rows()
    assert sorted(map(tuple, spelling.variants(spelling.word_counts(odd, misspelt_every=31)).collect())) == plain(counts([r[:2] for r in rows]))
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
    # A word of a hundred thousand letters and its neighbour; columns with the operator's own names.
    long = "xyzw" * 25_000
    wide = table_of(spark, [(1, f"{long} {long}", "n"), (2, f"{long[:-1]} {long[:-1]}", "n")], "doc_id long, text string, word string")
    assert {len(r.word): r.n_near for r in spelling.variants(spelling.word_counts(wide)).collect()} == {100_000: 1, 99_999: 1}


def test_query_equals_sql(spark, small, sql_rows):
    df = op11_spelling_variants(spark, small)
    assert sql_rows(df) == sql_rows(oracles.SPELLING)


def test_nothing_that_grows_is_broadcast(spark, small, monkeypatch):
    """Keys are ten times the words that they are sized by, and files are compressed: no join broadcasts, however small its side seems."""
    plans, written = [], spelling.written

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(spelling, "written", noted)
    df = op11_spelling_variants(spark, small)
    plans.append(("result", df._jdf.queryExecution().executedPlan().toString()))
    assert {"spelling-keys", "spelling-pairs", "spelling-links", "spelling-forms", "spelling-roots", "result"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "Broadcast" in plan] == []
