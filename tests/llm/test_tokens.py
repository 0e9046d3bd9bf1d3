"""Token counts, packed files and packed sequences against the tokenizers library."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from studyloom.llm import bitpack, bpe_counts, packing, word_ids
from studyloom.llm.queries import BYTE_TOKENIZER, WORD_TOKENIZER, op4_token_counts, op6_bit_packing, op10_packing
from studyloom.llm.word_ids import encoder
from studyloom.session import table

from .conftest import odd_rows

PATHS = {n: public_tokenizers.path(n) for n in (BYTE_TOKENIZER, WORD_TOKENIZER)}


@pytest.fixture(scope="module")
def library():
    return {n: Tokenizer.from_file(p) for n, p in PATHS.items()}


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]


def strange_texts() -> list[str]:
    r = random.Random(5)
    alphabets = ["abcABC  '\n\t0123.,-", "aé ßÜñ’“”…'sst", "漢字かな ab12", "a\u00a0\u2003\u3000\u0085b\x1c\x0b\x0c", "e\u0301\u0308aİıſK", "\U0001f600\u200d\U0001f469 x", "²³¼½ªº٣१a1", "<|endoftext|><|startoftext|> a"]
    out = ["".join(r.choice(a) for _ in range(r.randint(0, 60))) for a in alphabets for _ in range(60)]
    return out + ["aaaaaaaaaaaaaaaaaaaa", "a" * 5000, " " * 3000, "\n" * 77, "ab " * 4000, "\x00\x01\x7f", "<|endoftext|>", "x <|endoftext|> y", "I'LL 'Tis we'Ll"]


def test_counts_of_strange_texts(library):
    model = bpe_counts.merges(PATHS[BYTE_TOKENIZER])
    texts = strange_texts()
    want = [len(e.ids) for e in library[BYTE_TOKENIZER].encode_batch(texts, add_special_tokens=False)]
    assert model.count_texts(texts) == want


def test_ids_of_strange_texts(library):
    texts = strange_texts()
    got = [np.frombuffer(x, "<u4").tolist() for x in encoder(PATHS[WORD_TOKENIZER]).encode(texts)]
    want = [e.ids for e in library[WORD_TOKENIZER].encode_batch(texts, add_special_tokens=False)]
    assert [(t, g) for t, g in zip(texts, got, strict=True)] == list(zip(texts, want, strict=True))


def test_count_query(spark, small, docs, library):
    want = {d: (len(t.encode()), n := len(library[BYTE_TOKENIZER].encode(t, add_special_tokens=False).ids), n > 512) for d, t in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op4_token_counts(spark, small).collect()} == want


def test_counts_of_odd_texts(spark, odd, empty, library):
    got = bpe_counts.with_token_counts(odd, PATHS[BYTE_TOKENIZER], keep=["doc_id"]).collect()
    want = [(d, len((t or "").encode()), len(library[BYTE_TOKENIZER].encode(t or "", add_special_tokens=False).ids)) for d, t, *_ in odd_rows()]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe_counts.with_token_counts(empty, PATHS[BYTE_TOKENIZER]).count() == 0


def ids_of(library, text) -> np.ndarray:
    return np.array([*library[WORD_TOKENIZER].encode(text or "", add_special_tokens=False).ids, 2], "<u4")


def test_file_query(spark, small, docs, library):
    rows = sorted(op6_bit_packing(spark, small).collect())
    start = 0
    texts = dict(docs)
    assert [r.doc_id for r in rows] == sorted(texts)
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_files_of_odd_texts(spark, odd, empty, library):
    rows = bitpack.read_files(bitpack.write_files(odd, PATHS[WORD_TOKENIZER], 2, partitions=3, block_ids=64)).orderBy("start").collect()
    assert sorted(((r.doc_id, r.ids_crc32) for r in rows), key=str) == sorted(((d, zlib.crc32(ids_of(library, t).tobytes())) for d, t, *_ in odd_rows()), key=str)
    assert [r.doc_id or 0 for r in rows] == sorted(r.doc_id or 0 for r in rows)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert bitpack.read_files(bitpack.write_files(empty, PATHS[WORD_TOKENIZER], 2)).count() == 0


@pytest.mark.parametrize("bits", [1, 7, 8, 15, 16, 17, 31, 32])
def test_bits_round_trip(bits, tmp_path):
    r = np.random.default_rng(bits)
    ids = [r.integers(0, 1 << bits, n, dtype=np.uint64).astype("<u4") for n in (0, 1, 5, 300, 64, 64, 1000)]
    with open(tmp_path / "f", "wb") as f:
        w = bitpack.Writer(f, bits, 64)
        for i, x in enumerate(ids):
            w.add(i if i else None, x)
        w.close()
    with open(tmp_path / "f", "rb") as f:
        reader = bitpack.Reader(f)
        every = np.concatenate(ids)
        assert [d for d, _ in reader.documents()] == [None, *range(1, len(ids))]
        for i, x in enumerate(ids):
            assert (reader.document(i) == x).all()
        for a, b in ((0, 10), (63, 65), (100, 900), (len(every) - 1, len(every)), (7, 7)):
            assert (reader.ids(a, b) == every[a:b]).all()


def check_packing(rows, docs, library, limit=4096):
    """Every id in exactly one piece; sequences gapless; little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for d, t in docs:
        ids, at = ids_of(library, t), 0
        for r in sorted(by_doc.pop(d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not by_doc
    used = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limit
        used += at
        padded += at if at & (at - 1) == 0 else limit
    return used, padded


def test_packing_query(spark, small, docs, library):
    rows = op10_packing(spark, small).collect()
    used, padded = check_packing(rows, docs, library)
    assert padded - used < 4096


def test_packing_of_odd_texts(spark, odd, empty, library):
    rows = packing.pack(odd.where("doc_id is not null and doc_id <> 0 and doc_id <> 3"), PATHS[WORD_TOKENIZER], 2).collect()
    check_packing(rows, [(d, t) for d, t, *_ in odd_rows() if d not in (None, 0, 3)], library)
    assert packing.pack(odd, PATHS[WORD_TOKENIZER], 2).where("doc_id is null").count() >= 1
    assert packing.pack(empty, PATHS[WORD_TOKENIZER], 2).count() == 0
    groups = packing.pack(odd, PATHS[WORD_TOKENIZER], 2, step_tokens=4096).groupBy("step_group").sum("length").collect()
    assert max(r[1] for r in groups) <= 4096


def test_step_groups_are_even(spark, small):
    """Over all tasks, groups of a tier differ by one window and none is over its tokens."""
    docs = table(spark, small, "documents").select("doc_id", "text")
    pieces = packing.pack(docs.unionByName(docs).unionByName(docs).repartition(9), PATHS[WORD_TOKENIZER], 2, step_tokens=8192).collect()
    windows = {}
    for tier, group, sequence in {(r.tier, r.step_group, r.sequence_id) for r in pieces}:
        windows.setdefault(tier, {}).setdefault(group, set()).add(sequence)
    assert len({g for groups in windows.values() for g in groups}) == sum(map(len, windows.values()))
    for tier, groups in windows.items():
        sizes = [len(x) for x in groups.values()]
        assert max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= 8192
        assert len(sizes) == -(-sum(sizes) * tier // 8192)
    assert len(windows) == len(packing.TIERS)


def test_equal_rows_are_spread_over_files(spark, library):
    rows = [(7, "one two three")] * 4000 + [(i, f"text {i}") for i in range(2000)] + [(None, None)] * 2000
    files = bitpack.write_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATHS[WORD_TOKENIZER], 2, partitions=8)
    sizes = [r.n_docs for r in files.collect()]
    assert sum(sizes) == 8000 and max(sizes) < 2500
    got = [tuple(r) for r in bitpack.read_files(files).orderBy("start").select("doc_id", "ids_crc32").collect()]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    crc = {t: zlib.crc32(ids_of(library, t).tobytes()) for _, t in set(rows)}
    assert got == [(d, crc[t]) for d, t in want]


def test_files_follow_bytes(spark, odd, monkeypatch):
    monkeypatch.setattr(bitpack, "FILE_BYTES", 2000)
    size = odd.selectExpr("sum(octet_length(text))").first()[0]
    files = bitpack.write_files(odd, PATHS[WORD_TOKENIZER], 2, partitions=1)
    assert size > 6000 and files.count() > 3


def test_common_words_are_learned_once(library, monkeypatch):
    """Texts with more distinct words than 24 MB hold: what a worker has learned stays; with too little room the ids are the same."""
    model, learned = word_ids.WordEncoder(PATHS[WORD_TOKENIZER]), []
    learn = model._learn
    monkeypatch.setattr(model, "_learn", lambda words: learned.extend(words) or learn(words))
    names = ["".join(chr(97 + (i >> k) % 16) for k in (0, 4, 8, 12, 16)) for i in range(140_000)]
    for i in range(0, len(names), 20_000):
        model.encode([" ".join(["common", *names[i : i + 20_000]])])
    assert learned.count("common") == 1 and len(learned) == len(set(learned)) and model.held > 24 << 20
    texts = ["Don't 'rest x's3,4!'s  (end).\nthe\tend", "the end the end don't " + "long" * 30, "é,ß’ the ''s", ""]
    want = [e.ids for e in library[WORD_TOKENIZER].encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(word_ids, "REMEMBERED", 2000)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == want
