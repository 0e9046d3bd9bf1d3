"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is its hashed word embedding beside its characters' part: the mean embedding of the hashed 4- and 5-byte
grams of the word between its edges and of its beginnings of 6 to 8 bytes. Two gated recurrent layers read a window of
``WINDOW`` words forwards and backwards, attention pools their states, and a logistic unit scores the window. All
overlapping windows of the whole text are scored; a text's score is its highest window's, mapped so that 0.7 is the
fitted threshold.

Training is by multiple instances: labels belong to documents, so each pass trains on every document's highest window
(and random ones). The sample is bounded: at most ``SAMPLE_ROWS`` labelled rows of each class, lowest hashes of their
ids first, whatever their texts' sizes; of a text with more windows, ``SAMPLE_WINDOWS`` evenly spread over all of it
are learned from. Scoring covers whole texts of all rows, in parts of ``PART`` words, so that memory doesn't follow a text.

Beginnings of words are an input beside the inner grams, since a word whose ending is inflected or garbled keeps its
beginning; it is taken for every word alike.

Defined results: null, empty and wordless texts score 0; equal texts score alike; without labelled rows of both classes
every score is 0; of rows that repeat a labelled id with different texts the least text is learned from; other columns
pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lean, raw_bytes, slices

WINDOW, STRIDE = 64, 48
WORD_BITS, GRAM_BITS, WIDTH, HIDDEN = 14, 15, 8, 8
#: Bytes of the grams that are taken at a word's beginning alone, its edge counted.
PREFIXES = (6, 7, 8)
SAMPLE_ROWS, SAMPLE_WINDOWS = 2000, 64
EPOCHS, BATCH, RATE, SEED = 10, 128, 0.01, 11
THRESHOLD = 0.7
#: What a false alarm counts against a toxic text that is found, in shares of their classes.
COST = 4.0
#: Windows scored at once, and words whose inputs are summed at once.
BLOCK, WORDS = 2048, 1 << 15
#: Bytes of a text that are cut into words at once, and words of all texts whose windows are scored together.
CUT, PART = 1 << 18, 1 << 18

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Lexicon:
    """Distinct words of a few texts: ids in order of appearance, id 0 is padding."""

    def __init__(self):
        self.ids: dict[bytes, int] = {b"": 0}

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_words(text.translate(_FOLD).split())

    def encode_words(self, words: list[bytes]) -> np.ndarray:
        ids = self.ids
        return np.array([ids.setdefault(w, len(ids)) for w in words], np.int32)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word buckets, gram buckets of all words in a row, and where each word's grams begin."""
        words = list(self.ids)
        buckets = np.array([xxhash.xxh32_intdigest(w) & (1 << WORD_BITS) - 1 for w in words], np.int64)
        edged = [b"<" + w + b">" + b"\0" * max(0, 3 - len(w)) for w in words]
        size = np.array([len(w) for w in edged], np.int64)
        data = np.frombuffer(b"".join(edged) + b"\0" * 8, np.uint8).astype(np.uint64)
        begin = np.append(0, np.cumsum(size)[:-1])
        word, place = np.repeat(np.arange(len(words), dtype=np.int32), size), np.arange(size.sum())
        left = (begin + size)[word] - place  # bytes from here to the word's end
        code = np.zeros(len(place), np.uint64)
        for i in range(4):
            code = code << np.uint64(8) | data[place + i]
        grams, owner = [], []
        begins = place == begin[word]
        for n in (4, 5, *PREFIXES):
            if n > 4:
                code = code << np.uint64(8) | data[place + n - 1]
            fits = left >= n if n < 6 else (left >= n) & begins
            grams.append(((code[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - GRAM_BITS)).astype(np.int32))
            owner.append(word[fits])
        owner_all = np.concatenate(owner)
        order = np.argsort(owner_all, kind="stable")
        first = np.searchsorted(owner_all[order], np.arange(len(words)))
        return buckets, np.concatenate(grams)[order], first


def windows(ids: np.ndarray) -> np.ndarray:
    """All overlapping windows of a text; the last ends with the text, a short text is padded."""
    if len(ids) <= WINDOW:
        return np.pad(ids, (0, WINDOW - len(ids)))[None, :] if len(ids) else np.zeros((0, WINDOW), np.int32)
    starts = np.append(np.arange(0, len(ids) - WINDOW, STRIDE), len(ids) - WINDOW)
    return ids[starts[:, None] + np.arange(WINDOW)]


def parts_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in parts; the windows of the parts are together those of the text."""
    held: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + CUT
        while end < len(text) and _FOLD[text[end]] != 32:
            end += 1
        held += text[at:end].translate(_FOLD).split()
        at = end
        # So many windows are whole and leave a window's words at least.
        whole = (len(held) - WINDOW) // STRIDE
        if at < len(text) and whole > 0:
            yield held[: (whole - 1) * STRIDE + WINDOW]
            held = held[whole * STRIDE :]
    if held:
        yield held


def spread(text: bytes, most: int = SAMPLE_WINDOWS) -> list[bytes]:
    """The words of a text's windows as texts: the whole text, or ``most`` windows evenly spread over it."""
    n = sum(len(windows(np.zeros(len(p), np.int32))) for p in parts_of(text))
    if n <= most:
        return [text]
    wanted, at, out = set(np.linspace(0, n - 1, most).astype(int).tolist()), 0, []
    for part in parts_of(text):
        starts = np.append(np.arange(0, len(part) - WINDOW, STRIDE), max(0, len(part) - WINDOW)).tolist()
        out += [b" ".join(part[s : s + WINDOW]) for i, s in enumerate(starts) if at + i in wanted]
        at += len(starts)
    return out


def initial(seed: int = SEED) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {"word": r.normal(0, 0.1, (1 << WORD_BITS, WIDTH)), "gram": r.normal(0, 0.1, (1 << GRAM_BITS, WIDTH)), "v": r.normal(0, 0.3, 2 * HIDDEN), "wa": r.normal(0, 0.3, (2 * HIDDEN, 2 * HIDDEN)), "wo": r.normal(0, 0.3, 2 * HIDDEN), "bo": np.zeros(1)}
    for d in "fb":
        p |= {f"x{d}": r.normal(0, 0.3, (2 * WIDTH, 3 * HIDDEN)), f"u{d}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"b{d}": np.zeros(3 * HIDDEN)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def inputs(p: dict[str, np.ndarray], features) -> np.ndarray:
    buckets, grams, first = features
    sums = np.zeros((len(buckets), WIDTH), np.float32)
    ends = np.append(first, len(grams))
    for a in range(0, len(first), WORDS):  # so that memory doesn't follow the number of words
        b = min(a + WORDS, len(first))
        sums[a:b] = np.add.reduceat(p["gram"][grams[ends[a] : ends[b]]], first[a:b] - first[a], axis=0)
    counts = np.diff(np.append(first, len(grams)))[:, None].astype(np.float32)
    x = np.concatenate([p["word"][buckets], sums / counts], axis=1)
    x[0] = 0
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _layer(xz: np.ndarray, xn: np.ndarray, u: np.ndarray, ids: np.ndarray, back: bool, trace: list | None = None) -> np.ndarray:
    """States (time, window, unit) of one direction from projected word inputs."""
    n, t_all = ids.shape
    uz, un = np.ascontiguousarray(u[:, : 2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN :])
    h, out = np.zeros((n, HIDDEN), np.float32), np.empty((t_all, n, HIDDEN), np.float32)
    for t in range(t_all - 1, -1, -1) if back else range(t_all):
        at = ids[:, t]
        gates = _sigmoid(xz[at] + h @ uz)
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        inner = h @ un
        new = np.tanh(xn[at] + r * inner)
        if trace is not None:
            trace.append((t, h, z, r, inner, new))
        h = new + z * (h - new)
        out[t] = h
    return out


def forward(p, x: np.ndarray, ids: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits of windows."""
    states = []
    for d in "fb":
        proj = x @ p[f"x{d}"] + p[f"b{d}"]
        trace = [] if keep is not None else None
        states.append(_layer(np.ascontiguousarray(proj[:, : 2 * HIDDEN]), np.ascontiguousarray(proj[:, 2 * HIDDEN :]), p[f"u{d}"], ids, d == "b", trace))
        if keep is not None:
            keep[d] = trace
    s = np.concatenate(states, axis=2)
    a = np.tanh(s.reshape(-1, 2 * HIDDEN) @ p["wa"]).reshape(s.shape)
    e = a @ p["v"]
    e[(ids == 0).T] = -1e9
    e -= e.max(axis=0)
    w = np.exp(e)
    w /= w.sum(axis=0)
    c = np.einsum("tn,tnk->nk", w, s)
    if keep is not None:
        keep |= {"s": s, "a": a, "w": w, "c": c}
    return c @ p["wo"] + p["bo"]


def gradients(p, features, ids: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of windows."""
    x, k = inputs(p, features), {}
    logit = forward(p, x, ids, k)
    n = len(y)
    d = (_sigmoid(logit) - y).astype(np.float32) / n
    g = {"wo": k["c"].T @ d, "bo": np.array([d.sum()], np.float32)}
    dc = d[:, None] * p["wo"]
    s, a, w = k["s"], k["a"], k["w"]
    dw = np.einsum("nk,tnk->tn", dc, s)
    de = w * (dw - (w * dw).sum(axis=0))
    ds = w[:, :, None] * dc
    g["v"] = np.einsum("tn,tnk->k", de, a)
    da = (de[:, :, None] * p["v"]) * (1 - a * a)
    flat = da.reshape(-1, 2 * HIDDEN)
    g["wa"] = s.reshape(-1, 2 * HIDDEN).T @ flat
    ds = ds + (flat @ p["wa"].T).reshape(s.shape)
    dx = np.zeros_like(x)
    for part, name in enumerate("fb"):
        u = p[f"u{name}"]
        uz, un = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
        gu, dproj = np.zeros_like(u), np.zeros((len(x), 3 * HIDDEN), np.float32)
        dh = np.zeros((n, HIDDEN), np.float32)
        for t, h, z, r, inner, new in reversed(k[name]):
            dh = dh + ds[t][:, part * HIDDEN : (part + 1) * HIDDEN]
            dnew = dh * (1 - z) * (1 - new * new)
            dz = dh * (h - new) * z * (1 - z)
            dr = dnew * inner * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            dinner = dnew * r
            gu[:, : 2 * HIDDEN] += h.T @ gates
            gu[:, 2 * HIDDEN :] += h.T @ dinner
            np.add.at(dproj, ids[:, t], np.concatenate([gates, dnew], axis=1))
            dh = dh * z + gates @ uz.T + dinner @ un.T
        g[f"u{name}"], g[f"b{name}"], g[f"x{name}"] = gu, dproj.sum(axis=0), x.T @ dproj
        dx += dproj @ p[f"x{name}"].T
    dx[0] = 0
    buckets, grams, first = features
    counts = np.diff(np.append(first, len(grams)))
    per_gram = np.repeat(dx[:, WIDTH:] / counts[:, None], counts, axis=0)
    g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
    np.add.at(g["word"], buckets, dx[:, :WIDTH])
    for i in range(WIDTH):
        g["gram"][:, i] = np.bincount(grams, per_gram[:, i], len(p["gram"]))
    return g


def _logits(p, x, every: np.ndarray) -> np.ndarray:
    return np.concatenate([forward(p, x, every[i : i + BLOCK]) for i in range(0, len(every), BLOCK)]) if len(every) else np.zeros(0, np.float32)


def _subset(features, used: np.ndarray):
    """The features of the words ``used`` (id 0 first)."""
    buckets, grams, first = features
    size = np.diff(np.append(first, len(grams)))[used]
    begin = np.append(0, np.cumsum(size)[:-1])
    place = np.repeat(first[used] - begin, size) + np.arange(size.sum())
    return buckets[used], grams[place], begin


def train(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, np.ndarray] | None:
    """The fitted weights with ``scale`` and ``shift`` of the text's logit; None without both classes. A text is given as
    the list of its pieces (:func:`spread`). A fifth of the texts is left out of training to place the threshold."""
    lexicon = Lexicon()
    coded = [(np.concatenate([windows(lexicon.encode(t)) for t in pieces]), y) for pieces, y in zip(texts, labels, strict=True)]
    coded = [(i, y) for i, y in coded if len(i)]
    if len({y for _, y in coded}) < 2:
        return None
    r = np.random.default_rng(seed)
    order = r.permutation(len(coded))
    features = lexicon.features()
    per_doc = [coded[i][0] for i in order]
    y = np.array([coded[i][1] for i in order], np.float32)
    tuning = np.arange(len(y)) % 5 == 4
    if min(y[~tuning].sum(), (1 - y[~tuning]).sum()) < 1:
        tuning[:] = False
    first = np.append(0, np.cumsum([len(w) for w in per_doc]))
    every = np.concatenate(per_doc)
    p = initial(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    step, fit = 0, np.flatnonzero(~tuning)
    epochs = max(epochs, min(60, 20000 // max(1, len(fit))))  # small samples get more passes
    for epoch in range(epochs):
        best = [int(r.integers(first[i], first[i + 1])) for i in fit]
        if epoch:
            logit = _logits(p, inputs(p, features), every)
            top = [first[i] + int(np.argmax(logit[first[i] : first[i + 1]])) for i in fit]
            # Highest windows teach; the random ones of clean texts stay as further negatives.
            rows = np.array(top + [b for i, b in zip(fit, best, strict=True) if y[i] == 0])
            target = np.concatenate([y[fit], np.zeros(len(rows) - len(fit), np.float32)])
        else:
            rows, target = np.array(best), y[fit]
        shuffle = r.permutation(len(rows))
        for i in range(0, len(rows), BATCH):
            take = shuffle[i : i + BATCH]
            used, back = np.unique(np.append(0, every[rows[take]].ravel()), return_inverse=True)
            g = gradients(p, _subset(features, used), back[1:].reshape(len(take), WINDOW), target[take])
            step += 1
            rate = RATE * (1 - epoch / epochs) + 1e-4
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6) + 1e-4 * p[k])
    logit = _logits(p, inputs(p, features), every)
    highest = np.maximum.reduceat(logit, first[:-1])
    held = tuning if min(y[tuning].sum(), (1 - y[tuning]).sum()) >= 5 else ~tuning
    # The threshold lies between the classes of the tuning part, where the share of toxic texts found less ``COST`` times
    # the share of false alarms is highest.
    cut = np.sort(highest[held])
    cut = (cut[1:] + cut[:-1]) / 2
    right = [(highest[held][y[held] == 1] >= c).mean() - COST * (highest[held][y[held] == 0] >= c).mean() for c in cut]
    good = cut[np.flatnonzero(right >= np.max(right) - 1e-9)]
    return p | {"shift": np.array([good[len(good) // 2]], np.float32), "scale": np.array([1.0], np.float32)}


def _highest(p: dict[str, np.ndarray], owners: list[int], parts: list[list[bytes]], out: np.ndarray) -> None:
    """Raise ``out`` of each part's owner to its highest window."""
    lexicon = Lexicon()
    coded = [windows(lexicon.encode_words(words)) for words in parts]
    logit = _logits(p, inputs(p, lexicon.features()), np.concatenate(coded))
    np.maximum.at(out, np.repeat(owners, [len(w) for w in coded]), logit)


def score_texts(p: dict[str, np.ndarray] | None, texts: list[bytes]) -> np.ndarray:
    """Scores of whole texts."""
    out = np.zeros(len(texts))
    if p is None:
        return out
    highest = np.full(len(texts), -np.inf)
    owners, parts, held = [], [], 0
    for i, text in enumerate(texts):
        for words in parts_of(text):
            owners.append(i)
            parts.append(words)
            held += len(words)
            if held >= PART:
                _highest(p, owners, parts, highest)
                owners, parts, held = [], [], 0
    if parts:
        _highest(p, owners, parts, highest)
    full = highest > -np.inf
    # Rounded, so that equal texts score alike in whatever batch they are.
    z = np.round(p["scale"][0] * (highest[full] - p["shift"][0]) + np.log(THRESHOLD / (1 - THRESHOLD)), 3)
    out[full] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return out


def held_out(doc_id) -> F.Column:
    """Rows that training never sees: the CRC-32 of the id as text leaves one when divided by three."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS) -> dict[str, np.ndarray] | None:
    """Train on a bounded sample of labelled rows, held-out rows left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(doc_id).agg(F.max(label).cast("int").alias("y"))
    pick = [known.where(F.col("y") == y).orderBy(F.xxhash64(doc_id), doc_id).limit(rows) for y in (0, 1)]
    # At most 2 * rows ids are broadcast, and a list of windows' words of bounded size comes back for each.
    chosen = F.broadcast(pick[0].unionByName(pick[1]).select(F.col(doc_id).alias("_id"), "y"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2 << 20):
            pieces = [spread(x) for x in raw_bytes(batch.column("t")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("y"), pa.array(pieces, pa.list_(pa.binary()))], names=["_id", "y", "pieces"])

    texts = documents.select(F.col(doc_id).alias("_doc"), F.col(text).alias("t")).where("t is not null")
    sample = texts.join(chosen, F.col("_doc") == F.col("_id")).select(F.col("_id").cast("string"), "y", "t").mapInArrow(lean(cut), "_id string, y int, pieces array<binary>")
    got = sorted(((r._id, r.y, [bytes(x) for x in r.pieces]) for r in sample.groupBy("_id", "y").agg(F.min("pieces").alias("pieces")).collect()), key=lambda r: r[0])
    return train([x for *_, x in got], [y for _, y, _ in got])


def with_scores(documents: DataFrame, weights: dict[str, np.ndarray] | None, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The documents (their columns ``keep``, or all) with the score of the whole text; no shuffle."""
    keep = [c for c in (documents.columns if keep is None else keep) if c != out]
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField(out, T.DoubleType())])
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2 << 20):
            scores = score_texts(shared.value, [x or b"" for x in raw_bytes(batch.column(text)).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores)], names=[*keep, out])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), schema)


def drop_toxic(documents: DataFrame, weights: dict[str, np.ndarray] | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, as they are."""
    score = free_name(documents.columns, "score")
    return with_scores(documents, weights, text, score).where(F.col(score) < threshold).select(*documents.columns)
