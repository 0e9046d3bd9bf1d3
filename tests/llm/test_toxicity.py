"""Gradients by differences, held-out accuracy, and defined results."""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from studyloom.llm import toxicity
from studyloom.llm.queries import op5_toxicity
from studyloom.session import table

from .conftest import prose


def test_gradients_equal_differences():
    lexicon = toxicity.Lexicon()
    ids = np.stack([np.resize(lexicon.encode(prose(i, 30 + i).encode()), toxicity.WINDOW) for i in range(5)])
    ids[0, 40:] = 0
    y = np.array([1, 0, 1, 0, 0], np.float32)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    features = lexicon.features()

    def loss(q):
        z = toxicity.forward(q, toxicity.inputs(q, features), ids).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g = toxicity.gradients({k: v.astype(np.float32) for k, v in p.items()}, features, ids, y)
    r = np.random.default_rng(0)
    for name, value in p.items():
        for _ in range(6):
            at = tuple(int(r.choice(np.unique(a))) for a in np.nonzero(g[name])) if g[name].any() else tuple(0 for _ in value.shape)
            step = 1e-2
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += step
            down[name][at] -= step
            slope = (loss({k: v.astype(np.float32) for k, v in up.items()}) - loss({k: v.astype(np.float32) for k, v in down.items()})) / (2 * step)
            assert abs(slope - g[name][at]) < 2e-3 + 0.05 * abs(slope), (name, at, slope, g[name][at])


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    scored = {r.doc_id: r for r in op5_toxicity(spark, at).collect()}
    texts = {r.doc_id: r.text for r in table(spark, at, "documents").collect()}
    assert set(scored) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in scored.items())
    held = [(r.toxic, scored[r.doc_id].predicted) for r in table(spark, at, "labels").collect() if r.doc_id in scored and scored[r.doc_id].held_out and r.toxic is not None]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert np.mean(toxic) > 0.8 and np.mean(clean) < 0.03, (np.mean(toxic), len(toxic), np.mean(clean), len(clean))
    by_text = {}
    assert all(by_text.setdefault(texts[d], r.score) == r.score for d, r in scored.items())


def test_defined_results(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 0, 1), (5, None, None), (6, 0, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    weights = toxicity.fit(odd, labels)
    got = toxicity.with_scores(odd.withColumn("score", F.lit("x")), weights).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if not (r.text or "").strip()} == {0.0}
    assert toxicity.fit(odd, labels.limit(0)) is None and toxicity.fit(empty, labels) is None
    assert {r.score for r in toxicity.with_scores(odd, None).collect()} == {0.0}
    assert toxicity.drop_toxic(empty, weights).count() == 0


def test_windows_cover_whole_texts():
    for n in (1, 63, 64, 65, 111, 112, 113, 1000):
        ids = np.arange(1, n + 1, dtype=np.int32)
        assert set(toxicity.windows(ids).ravel()) - {0} == set(range(1, n + 1))


def test_scores_equal_a_plain_forward_pass():
    p = toxicity.initial(3) | {"shift": np.array([0.2], np.float32), "scale": np.array([1.0], np.float32)}
    text = prose(9, 150).encode()
    words = text.split()
    sig = lambda x: 1 / (1 + np.exp(-x))
    H = toxicity.HIDDEN

    def vector(w):
        edged = b"<" + w + b">" + b"\0" * max(0, 3 - len(w))
        parts = [edged[i : i + n] for n in (4, 5) for i in range(len(edged) - n + 1)] + [edged[:n] for n in toxicity.PREFIXES if len(edged) >= n]
        at = [((int.from_bytes(g, "big") + len(g)) * 0x9E3779B97F4A7C15 % (1 << 64)) >> (64 - toxicity.GRAM_BITS) for g in parts]
        return np.concatenate([p["word"][xxhash.xxh32_intdigest(w) & (1 << toxicity.WORD_BITS) - 1], np.mean(p["gram"][at], axis=0) if at else np.zeros(toxicity.WIDTH)])

    def direction(vectors, d):
        h, out = np.zeros(H), []
        for x in vectors:
            xs = x @ p[f"x{d}"] + p[f"b{d}"]
            hs = h @ p[f"u{d}"]
            z, r = sig(xs[:H] + hs[:H]), sig(xs[H : 2 * H] + hs[H : 2 * H])
            h = z * h + (1 - z) * np.tanh(xs[2 * H :] + r * hs[2 * H :])
            out.append(h)
        return out

    best = -np.inf
    for s in [*range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE), len(words) - toxicity.WINDOW]:
        vectors = [vector(w) for w in words[s : s + toxicity.WINDOW]]
        states = np.concatenate([direction(vectors, "f"), direction(vectors[::-1], "b")[::-1]], axis=1)
        weight = np.exp(np.tanh(states @ p["wa"]) @ p["v"])
        best = max(best, float((weight / weight.sum()) @ states @ p["wo"] + p["bo"][0]))
    want = sig(best - 0.2 + np.log(0.7 / 0.3))
    assert abs(toxicity.score_texts(p, [text])[0] - want) < 2e-3


def test_long_texts_score_alike_in_parts(monkeypatch):
    p = toxicity.initial(4) | {"shift": np.array([0.0], np.float32), "scale": np.array([1.0], np.float32)}
    texts = [prose(i, n).encode() for i, n in enumerate((1, 63, 64, 65, 700, 1500, 3000))] + [b"", b" x" * 2000]
    whole = toxicity.score_texts(p, texts)
    for cut, part in ((50, 100), (333, 1 << 18), (1000, 64)):
        monkeypatch.setattr(toxicity, "CUT", cut)
        monkeypatch.setattr(toxicity, "PART", part)
        assert np.allclose(toxicity.score_texts(p, texts), whole, atol=1e-9)
    n = len(toxicity.windows(np.arange(3000)))
    assert len(toxicity.spread(texts[6], 7)) == 7 and toxicity.spread(texts[6], n) == [texts[6]]


def test_memory_does_not_follow_a_text():
    import tracemalloc

    p = toxicity.initial(5) | {"shift": np.array([0.0], np.float32), "scale": np.array([1.0], np.float32)}
    peaks = []
    for n in (400_000, 4_000_000):
        text = prose(11, n // 7).encode()
        tracemalloc.start()
        toxicity.score_texts(p, [text])
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0]
