"""The registered query writes tensors and reads its features from them; frames cover the whole payload."""

from __future__ import annotations

import math

import numpy as np

from studyloom.llm import media, queries

from .conftest import prose, table_of


def test_frames_cover_the_payload():
    for units in range(1, 40):
        n = media.UNIT * units
        covered = ((media.n_frames(n) - 1) * media.HOP + media.FRAME) * media.DOWN // media.UP
        assert covered >= n


def test_features_come_from_written_tensors(spark, tmp_path, monkeypatch):
    docs = table_of(spark, [(i, prose(i, 20 + 90 * i), "en", "s", 1) for i in range(9)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    names, write = [], media.written
    tables = {}

    def written(df, name):
        tables[name] = write(df, name)
        names.append(name)
        return tables[name]

    monkeypatch.setattr(media, "written", written)
    got = {r.doc_id: r.feature for r in queries.op3_audio_features(spark, str(tmp_path)).collect()}
    assert names == ["media", "tensors"]
    for r in tables["tensors"].collect():
        total = media.n_frames(r.payload_bytes)
        values = np.array(r.tensor, np.float32).reshape(-1, media.MELS)
        assert len(r.t0) == len(r.t1) == len(r.tensor) == -(-total // media.PATCH) and r.t0[0] == 0
        assert round(r.t1[-1] * media.RATE, 6) >= r.payload_bytes
        assert got[r.doc_id] == media.summary(values[:total])


def plain_feature(data: bytes) -> str:
    """The whole feature by loops over samples, frames, bins and bands."""
    x = [(b - 128) / 128 for b in data]
    taps = media.filter_taps()
    width = taps.shape[1]
    n = -(-len(x) * media.UP // media.DOWN)
    total = media.n_frames(len(x))
    y = [0.0] * max(n, (total - 1) * media.HOP + media.FRAME)
    for i in range(len(y)):
        phase, base = i * media.DOWN % media.UP, i * media.DOWN // media.UP - width // 2 + 1
        y[i] = sum(float(taps[phase, width - 1 - k]) * x[base + k] for k in range(width) if 0 <= base + k < len(x))
    rate = media.RATE * media.UP / media.DOWN
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (i * mel(rate / 2) / (media.MELS + 1) / 2595) - 1) for i in range(media.MELS + 2)]
    rows = []
    for f in range(total):
        frame = np.array(y[f * media.HOP : f * media.HOP + media.FRAME]) * np.hanning(media.FRAME)
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(media.FRAME) / media.FRAME))) ** 2 for k in range(media.FRAME // 2 + 1)]
        row = []
        for b in range(media.MELS):
            low, mid, high = edges[b : b + 3]
            total_power = sum(p * max(0.0, min((k * rate / media.FRAME - low) / (mid - low), (high - k * rate / media.FRAME) / (high - mid))) for k, p in enumerate(power))
            row.append(round(max(math.log10(total_power + 1e-10), media.FLOOR) * media.STEPS) / media.STEPS)
        rows.append(row)
    energy = [math.log10(sum(10.0**v for v in row)) for row in rows]
    mean = sum(energy) / total
    spread = math.sqrt(sum((e - mean) ** 2 for e in energy) / total)
    on, spans = None, []
    for i, e in enumerate([*energy, -math.inf]):
        if on is None and e > mean + 0.1 * spread:
            on = i
        elif on is not None and e < mean - 0.1 * spread:
            spans.append((on, i))
            on = None
    active = sum((e - 1 - s) * media.HOP / rate + media.FRAME / rate for s, e in spans)
    size = media.MELS // 6
    means = [sum(row[b] for row in rows for b in range(g * size, (g + 1) * size)) / (total * size) for g in range(6)]
    return f"frames={total};segments={len(spans)};active={active:.3f};mel=" + ",".join(f"{m:.2f}" for m in means)


def test_features_equal_a_plain_form(spark):
    texts = [prose(i, 40 + 35 * i) for i in range(4)] + ["", "Ünïcode ß 漢字 " * 20]
    stored = media.store(table_of(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]), keep=["doc_id"])
    for r in media.described(stored, ["doc_id", "n_bytes"]).collect():
        got, want = r.feature, plain_feature(media.payload_of(texts[r.doc_id].encode()))
        assert got.split("mel=")[0] == want.split("mel=")[0]
        assert np.allclose([float(x) for x in got.split("mel=")[1].split(",")], [float(x) for x in want.split("mel=")[1].split(",")], atol=0.021)
