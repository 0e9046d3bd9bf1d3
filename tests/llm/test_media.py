"""Exact round trips, and plain reference forms of the features."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np

from studyloom.llm import media
from studyloom.llm.queries import op3_audio_features
from studyloom.session import table

from .conftest import odd_rows


def payload(text):
    b = (text or "").encode()
    return b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))


def check(rows, docs):
    assert len(rows) == len(docs)
    by = {}
    for doc, text in docs:
        p = payload(text)
        by.setdefault(doc, []).append((len((text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in by[r.doc_id]
        assert r.media_bytes == 44 + r.payload_bytes


def test_query_round_trip(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    rows = op3_audio_features(spark, small).collect()
    check(rows, docs)
    texts = dict(docs)
    values = {}
    for r in rows:
        assert values.setdefault(texts[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_texts(spark, odd, empty):
    stored = media.store(odd, keep=["doc_id"])
    check(media.described(stored, ["doc_id", "n_bytes"]).collect(), [(r[0], r[1]) for r in odd_rows()])
    assert media.described(media.store(empty), ["doc_id", "n_bytes"]).count() == 0
    tensors = media.patches(stored, ["doc_id"])
    for r in tensors.limit(5).collect():
        assert len(r.tensor) == media.PATCH * media.MELS and 0 <= r.t0 < r.t1
    back = media.as_tensors(tensors.limit(5).toArrow().column("tensor").combine_chunks())
    assert back.to_numpy_ndarray().shape == (5, media.PATCH, media.MELS)


def test_stored_form_is_a_wave_file():
    data = media.wave(payload("abc"))
    with wave.open(io.BytesIO(data)) as f:
        assert (f.getsampwidth(), f.getnchannels(), f.getframerate()) == (1, 1, media.RATE)
        assert f.readframes(f.getnframes()) == payload("abc") == media.samples_of(data)


def test_resampling_equals_a_plain_filter():
    r = np.random.default_rng(1)
    samples = r.integers(0, 256, 1500).astype(np.uint8)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        taps = media.filter_taps(up, down)
        x = (samples.astype(np.float64) - 128) / 128
        n = len(samples) * up // down
        width = taps.shape[1]
        want = np.zeros(n)
        for i in range(n):
            phase, base = (i * down) % up, i * down // up - width // 2 + 1
            want[i] = sum(taps[phase, width - 1 - k] * x[base + k] for k in range(width) if 0 <= base + k < len(x))
        whole = media.resample(samples, 0, n, up, down, taps)
        assert np.allclose(whole, want, atol=1e-5)
        assert np.allclose(media.resample(samples, 37, 200, up, down, taps), want[37:237], atol=1e-5)


def test_segments_equal_a_state_machine():
    r = np.random.default_rng(2)
    for _ in range(50):
        energy = r.normal(size=60)
        on, spans, begin = False, [], 0
        for i, e in enumerate(energy):
            if not on and e > 0.4:
                on, begin = True, i
            elif on and e < -0.4:
                on = False
                spans.append((begin, i))
        assert media.hysteresis(energy, -0.4, 0.4) == spans + [(begin, 60)] * on
