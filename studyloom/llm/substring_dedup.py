"""Removal of long repeated substrings, by sampled anchors and hashed names of the runs around them.

The job finds every start of a ``length``-byte string that also starts anywhere else and removes the bytes such strings
cover. Sorting every suffix of a corpus outside memory moves each byte many times, so this isn't external induced sorting:
nearly all repeats are settled by names, and suffixes are ordered only in small groups, in memory:

1. Sampling. A string's anchor is its leftmost position with the lowest rolling hash of ``k`` bytes. Anchors depend on
   the string alone, so equal strings have equal anchors at equal offsets. Neighbouring starts share an anchor and make
   a run; there are about 2 runs in ``length`` bytes.
2. Recursion on names. Runs are named by anchor hash and the hash of all bytes that their strings cover. A name that
   occurs twice settles its runs; an anchor hash with one name only settles its run, too (nothing repeats).
3. Sorting. What is left is shuffled by anchor hash; suffixes at the anchor are ordered in memory
   inside its small group, and neighbours' common-prefix lengths give classes of equal right contexts of any length. The
   same is done for the reversed text before the anchor.
4. Induction. For the strings that begin o bytes before the anchor, suffix tuples (left class at o, right class at
   length - o) are made from the common-prefix values; a tuple that occurs twice is a repeated string.

An anchor with more than ``group_limit`` unsettled runs is not sorted in one task: its runs are cut by offset into blocks,
named as in step 2 and halved again where more than the limit still meet, down to single strings. Names are compared by
hashes of 128 bits in all, bytes only inside groups, so results are exact up to collisions of those.

Passages are found the same way over words: each word becomes ``CODE`` bytes of its hash, so a passage of so many words is
a string of one length whatever its words are.

Defined results: null texts are empty; texts shorter than ``length`` never lose bytes; repeated rows (also with equal or
null ids) each count as occurrences; matches never cross documents; other columns pass through; an empty table gives an
empty result. Cutting may split a UTF-8 character, as the bytes are what is compared; ``drop_repeats`` drops the
incomplete characters that this leaves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lean, raw_bytes, slices, written

LENGTH, K = 400, 48
#: Bytes of a word's hash where passages are matched by words.
CODE = 6
_WORD, _BLANK = re.compile(rb"[^\x20\x09-\x0D]+"), re.compile(rb"[\x20\x09-\x0D]")
_IN_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)], np.int8)
#: Repeated passages are so many words or more.
PASSAGE_WORDS = 51
GROUP_LIMIT = 256
#: Starts handled at once by the sampling step, and unsettled runs by the induction.
CHUNK, BATCH_RUNS = 1 << 19, 4096

_BASE = np.uint64(0x9E3779B97F4A7C15)
_RANDOM = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if 0 not in _POWERS or len(_POWERS[0][0]) < n:
        up = np.full(n, _BASE)
        up[0] = 1
        down = np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
        down[0] = 1
        _POWERS[0] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    up, down = _POWERS[0]
    return up[:n], down[:n]


def rolling_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k bytes at every position that has k bytes."""
    up, down = _powers(len(data))
    total = np.add.accumulate(_RANDOM[data] * up)
    h = total[k - 1 :].copy()
    h[1:] -= total[: len(h) - 1]
    h *= down[: len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def coded(data: bytes) -> bytes:
    """``CODE`` bytes of a hash for each word, so that strings of words are strings of one size."""
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        if end < len(data):
            found = _BLANK.search(data, end)
            end = found.start() if found else len(data)
        piece = np.frombuffer(data[at:end], np.uint8)
        at = end
        edge = np.flatnonzero(np.diff(np.concatenate(([0], _IN_WORD[piece], [0]))))
        if not len(edge):
            continue
        first, last = edge[::2], edge[1::2]
        up, down = _powers(len(piece))
        total = np.append(np.uint64(0), np.add.accumulate(_RANDOM[piece] * up))
        h = (total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        parts.append(h.view(np.uint8).reshape(-1, 8)[:, :CODE].tobytes())
    return b"".join(parts)


def _window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, from running minima of blocks of w in both directions."""
    n = len(x)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs_of_text(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """The runs of a text: first start, last start, anchor, anchor hash, name, and whether the row is the joined rest of
    neighbouring runs of the same name as the row before (as in one character repeated)."""
    parts: list[tuple[np.ndarray, ...]] = []
    starts = len(data) - length + 1
    for begin in range(0, max(starts, 0), CHUNK):
        n = min(CHUNK, starts - begin)
        piece = np.frombuffer(data, np.uint8, n + length - 1, begin)
        h = rolling_hashes(piece, k)
        # The leftmost lowest: upper bits of the hash, then the place.
        low = _window_minima((h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last = np.append(first[1:] - 1, n - 1)
        a = anchor[first]
        parts.append((first + begin, last + begin, a + begin, h[a].view(np.int64)))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none.astype(bool)
    lo, hi, a, key = (np.concatenate(x) for x in zip(*parts, strict=True))
    digest = xxhash.xxh3_64_intdigest
    names = np.array([digest(data[s : e + length], x - s) for s, e, x in zip(lo.tolist(), hi.tolist(), a.tolist(), strict=True)], np.uint64).view(np.int64)
    # Neighbouring runs of one name: the first stays, the others are one row.
    same = np.append(False, (names[1:] == names[:-1]) & (key[1:] == key[:-1]))
    head = np.flatnonzero(~same | np.append(True, ~same[:-1]))
    end = np.append(head[1:], len(lo)) - 1
    return lo[head], hi[end], a[head], key[head], names[head], same[head]


_RUN = "k1 long, k2 long, anchor long, name long, lo long, hi long, a long, rest boolean"


def _runs(texts: DataFrame, length: int, k: int, by_words: bool) -> DataFrame:
    """(k1, k2, text) to one row for each run, of the text's bytes or of its words' codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            rows = []
            for k1, k2, x in zip(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), raw_bytes(batch.column("text")).to_pylist(), strict=True):
                x = coded(x) if x and by_words else x
                if x is not None and len(x) >= length:
                    lo, hi, a, key, name, rest = runs_of_text(x, length, k)
                    rows.append((np.full(len(lo), k1), np.full(len(lo), k2), key, name, lo, hi, a, rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], names=[x.split()[0] for x in _RUN.split(", ")])

    return texts.mapInArrow(lean(run), _RUN)


def _common_prefix(rows: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it."""
    differs = rows[1:] != rows[:-1]
    at = differs.argmax(axis=1)
    at[~differs.any(axis=1)] = rows.shape[1]
    return np.append(0, at)


def induced_repeats(key: np.ndarray, left: list[bytes], right: list[bytes], near: np.ndarray, length: int) -> list[np.ndarray]:
    """For each run (grouped by anchor ``key``), the offsets before the anchor whose strings occur in another run.
    ``left``: bytes from the run's first start to its anchor; ``right``: from the anchor to the end of its last string;
    ``near``: anchor minus last start, the least offset."""
    n = len(key)
    far = np.array([len(x) for x in left])
    _, group = np.unique(key, return_inverse=True)

    def order(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.zeros((n, width), np.uint8)
        for i, x in enumerate(parts):
            rows[i, : len(x)] = np.frombuffer(x, np.uint8)
        at = np.array(sorted(range(n), key=lambda i: (group[i], parts[i])))
        prefix = _common_prefix(rows[at])
        prefix[np.append(True, group[at][1:] != group[at][:-1])] = -1
        return at, prefix

    # Contexts of unequal sizes are padded; classes are read only at lengths that the run has.
    by_right, right_prefix = order(right, max(map(len, right)))
    by_left, left_prefix = order([x[::-1] for x in left], max(1, far.max()))
    found: list[list[int]] = [[] for _ in range(n)]
    right_class, left_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(near.min()), int(far.max()) + 1):
        own = np.flatnonzero((near <= o) & (o <= far))
        if len(own) < 2:
            continue
        right_class[by_right] = np.cumsum(right_prefix < length - o)
        left_class[by_left] = np.cumsum(left_prefix < o)
        tuples = left_class[own] * (n + 1) + right_class[own]
        names, back, counts = np.unique(tuples, return_inverse=True, return_counts=True)
        for i in own[counts[back] > 1].tolist():
            found[i].append(o)
    return [np.array(x, np.int64) for x in found]


_SPAN = "k1 long, k2 long, lo long, hi long"


def _starts_to_spans(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    starts = np.sort(starts)
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + length).tolist(), strict=True))


def _induce(pieces: DataFrame, length: int) -> DataFrame:
    """Unsettled runs, shuffled by anchor and sorted, to the spans of their repeated strings."""

    def settle(table: pa.Table) -> pa.RecordBatch | None:
        key, lo, hi, a, k1, k2 = (table.column(c).to_numpy() for c in ("anchor", "lo", "hi", "a", "k1", "k2"))
        data = raw_bytes(table.column("data").combine_chunks()).to_pylist()
        left = [x[:o] for x, o in zip(data, (a - lo).tolist(), strict=True)]
        right = [x[o:] for x, o in zip(data, (a - lo).tolist(), strict=True)]
        out = []
        for i, offsets in enumerate(induced_repeats(key, left, right, a - hi, length)):
            if len(offsets):
                out += [(k1[i], k2[i], s, e) for s, e in _starts_to_spans(a[i] - offsets, length)]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["k1", "k2", "lo", "hi"]) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in slices(batches, "data", 1 << 20):
            held.append(batch)
            if sum(b.num_rows for b in held) >= BATCH_RUNS:
                table = pa.Table.from_batches(held)
                keys = table.column("anchor").to_numpy()
                cut = np.flatnonzero(keys != keys[-1])
                if len(cut):
                    n = int(cut[-1]) + 1
                    if (out := settle(table.slice(0, n))) is not None:
                        yield out
                    held = table.slice(n).to_batches()
        if held and (out := settle(pa.Table.from_batches(held))) is not None:
            yield out

    return pieces.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lean(run), _SPAN)


def _halve(crowd: DataFrame, length: int, width: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Runs of crowded anchors to (sure spans, pieces of groups within ``limit``), by recursion on halves of the offsets.

    A block is the strings of a run whose offsets before the anchor lie in one of the aligned ranges of ``width``. All
    strings of a block share its core, so only blocks of equal cores can hold equal strings. As for whole runs, a block
    whose bytes occur twice is settled, one of each stands for its like, and a core with one block is settled, too. What
    is left in small groups is compared, in large groups halved again; blocks of one string are always settled."""
    sure, small = [], []
    while width >= 1:
        half = crowd.select("*", F.explode(F.expr(f"sequence((a - hi) div {width}, (a - lo) div {width})")).alias("j"))
        half = half.withColumns({"new_lo": F.greatest("lo", F.expr(f"a - j * {width} - {width - 1}")), "new_hi": F.least("hi", F.expr(f"a - j * {width}"))})
        half = half.select("k1", "k2", "anchor", "a", "j", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), F.expr(f"substring(data, cast(new_lo - lo + 1 as int), cast(new_hi - new_lo + {length} as int))").alias("data"))
        core = F.expr(f"xxhash64(anchor, j, substring(data, cast(a - j * {width} - lo + 1 as int), {length - width + 1}))")
        named = half.withColumns({"core": core, "name": F.xxhash64(F.col("a") - F.col("lo"), F.col("hi") - F.col("lo"), "data"), "token": F.xxhash64("k1", "k2", "lo")}).drop("anchor", "j")
        blocks = written(named.withColumnRenamed("core", "anchor"), "blocks")
        names = blocks.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min("token").alias("head"))
        cores = names.groupBy("anchor").agg(F.count("*").alias("names")).where("names > 1")
        known = names.join(cores, "anchor", "left").where("n > 1 or names > 1")
        left = written(blocks.join(known, ["anchor", "name"]), "blocks-left")
        sure.append(left.where("n > 1").select("k1", "k2", "lo", (F.col("hi") + length).alias("hi")))
        compare = left.where("names is not null and (n = 1 or token = head)")
        small.append(compare.where(F.col("names") <= limit).select("k1", "k2", "anchor", "lo", "hi", "a", "data"))
        crowd = compare.where(F.col("names") > limit)
        if crowd.isEmpty():
            break
        width //= 2
    return reduce(DataFrame.unionByName, sure), reduce(DataFrame.unionByName, small)


def _key(documents: DataFrame, doc_id: str, text: str) -> list:
    """A document's key: its id and a hash of id and text. Rows with equal keys are equal and get equal results."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("k1"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("k2")]


def repeated_spans(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = K, group_limit: int = GROUP_LIMIT, out: str = "spans") -> DataFrame:
    """All columns of the documents with ``out``: the byte spans that repeated strings cover, flattened (first and
    last-plus-one byte of each maximal span in ascending order). A column of that name is replaced."""
    return _with_spans(documents, {out: _spans(documents, doc_id, text, length, k, group_limit, False)}, doc_id, text)


def repeated_passages(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = PASSAGE_WORDS, k: int = K, group_limit: int = GROUP_LIMIT, out: str = "passages") -> DataFrame:
    """As :func:`repeated_spans`, for passages of ``words`` words or more: spans of words instead of bytes."""
    return _with_spans(documents, {out: _words_of(_spans(documents, doc_id, text, CODE * words, k, group_limit, True))}, doc_id, text)


def repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, words: int = PASSAGE_WORDS, k: int = K, group_limit: int = GROUP_LIMIT, spans: str = "spans", passages: str = "passages") -> DataFrame:
    """The documents with both: byte spans of repeated strings, word spans of repeated passages."""
    found = {spans: _spans(documents, doc_id, text, length, k, group_limit, False), passages: _words_of(_spans(documents, doc_id, text, CODE * words, k, group_limit, True))}
    return _with_spans(documents, found, doc_id, text)


def _words_of(spans: DataFrame) -> DataFrame:
    """Spans of codes as spans of words. Strings that don't begin at a word's code are inside others that do, but for
    chance equalities of parts of codes, which the rounding drops."""
    lo, hi = F.expr(f"(s.lo + {CODE - 1}) div {CODE}"), F.expr(f"s.hi div {CODE}")
    rows = spans.select("k1", "k2", F.explode("found").alias("s")).select("k1", "k2", lo.alias("lo"), hi.alias("hi"))
    return rows.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))


def _spans(documents: DataFrame, doc_id: str, text: str, length: int, k: int, group_limit: int, by_words: bool) -> DataFrame:
    """(k1, k2, found): the spans of repeated strings of ``length``, in no order; documents without any have no row."""
    texts = documents.select(*_key(documents, doc_id, text), F.col(text).alias("text"))
    runs = written(_runs(texts, length, k, by_words), "runs")
    # A joined rest never stands for its name.
    token = F.when(F.col("rest"), F.lit((1 << 63) - 1)).otherwise(F.xxhash64("k1", "k2", "lo"))
    names = runs.groupBy("anchor", "name").agg(F.count("*").alias("n"), F.min(token).alias("head"))
    anchors = names.groupBy("anchor").agg(F.count("*").alias("names")).where("names > 1")
    known = names.join(anchors, "anchor", "left").where("n > 1 or names > 1")
    hits = written(
        runs.join(known, ["anchor", "name"]).select(
            "k1", "k2", "anchor", "lo", "hi", "a", "names", (F.col("n") > 1).alias("sure"),
            # Of the runs with one name, one stands for all where others are compared with it.
            (F.col("names").isNotNull() & ((F.col("n") == 1) | (token == F.col("head")))).alias("compare"),
        ),
        "hits",
    )
    wanted = hits.where("compare").groupBy("k1", "k2").agg(F.collect_list(F.struct("anchor", "lo", "hi", "a", "names", "sure")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("anchor", "lo", "hi", "a", "names", "sure")
        for batch in slices(batches, "text", 2 << 20):
            out = []
            for k1, k2, x, runs in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2")), raw_bytes(batch.column("text")).to_pylist(), batch.column("runs").to_pylist(), strict=True):
                x = coded(x) if by_words else x
                out += [(k1, k2, *(r[f] for f in fields), x[r["lo"] : r["hi"] + length]) for r in runs]
            if out:
                types = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["k1", "k2", *fields, "data"])

    pieces = texts.join(wanted, ["k1", "k2"]).mapInArrow(lean(cut), "k1 long, k2 long, anchor long, lo long, hi long, a long, names long, sure boolean, data binary")
    pieces = written(pieces, "pieces")
    sure = hits.where("sure").select("k1", "k2", "lo", (F.col("hi") + length).alias("hi"))
    crowd, small = (pieces.where(x).select("k1", "k2", "anchor", "lo", "hi", "a", "data") for x in (F.col("names") > group_limit, F.col("names") <= group_limit))
    if not crowd.isEmpty():
        # Offsets are from 0 to length - k; the first halves are of half the next power of two.
        more_sure, more_small = _halve(crowd, length, max(1, (1 << (length - k).bit_length()) // 2), group_limit)
        sure, small = sure.unionByName(more_sure), small.unionByName(more_small)
    spans = sure.unionByName(_induce(small, length))
    return written(spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("found")), "spans")


def _maximal(found) -> F.Column:
    """Spans in any order to one maximal span after the other, flattened, in order of starts."""
    none = F.array().cast("array<bigint>")
    merged = F.aggregate(
        F.sort_array(found),
        none,
        lambda done, s: F.when((F.size(done) > 0) & (s["lo"] <= F.element_at(done, -1)), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.greatest(F.element_at(done, -1), s["hi"])))).otherwise(F.concat(done, F.array(s["lo"], s["hi"]))),
    )
    return F.coalesce(merged, none)


def _with_spans(documents: DataFrame, found: dict[str, DataFrame], doc_id: str, text: str) -> DataFrame:
    """All columns of the documents (as one, so that none clashes) joined with the spans of their keys."""
    joined = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), *_key(documents, doc_id, text))
    for i, (name, spans) in enumerate(found.items()):
        joined = joined.join(spans.withColumnRenamed("found", f"found{i}"), ["k1", "k2"], "left")
    kept = [c for c in documents.columns if c not in found]
    return joined.select(*(F.col("row")[c].alias(c) for c in kept), *(_maximal(F.col(f"found{i}")).alias(name) for i, name in enumerate(found)))


def _kept(x: bytes, spans: list[int]) -> bytes:
    edges = [0, *spans, len(x)]
    return b"".join(x[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def digest_kept(found: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with bytes, removed bytes, maximal spans, the SHA-256 of the remaining bytes and, of :func:`repeats`, the
    words in repeated passages."""
    both = "passages" in found.columns
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_words long" * both
    schema = T.StructType([*(found.schema[c] for c in keep), *T._parse_datatype_string(fields).fields])
    kinds = [pa.string() if f.dataType == T.StringType() else pa.int64() for f in schema.fields[len(keep) :]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = []
            passages = batch.column("passages").to_pylist() if both else repeat(None)
            for x, spans, words in zip(raw_bytes(batch.column(text)).to_pylist(), batch.column("spans").to_pylist(), passages):
                x = x or b""
                kept = _kept(x, spans)
                rows.append((len(x), len(x) - len(kept), len(spans) // 2, hashlib.sha256(kept).hexdigest(), *([sum(words[1::2]) - sum(words[::2])] if both else [])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], names=schema.names)

    return found.select(*dict.fromkeys([*keep, text, "spans", *["passages"] * both])).mapInArrow(lean(run), schema)


def _with_passages(x: bytes, spans: list[int], passages: list[int]) -> list[int]:
    """``spans`` together with the bytes of ``passages`` (spans of words), flattened and maximal."""
    edges = [m.span() for m in _WORD.finditer(x)]
    found = list(zip(spans[::2], spans[1::2], strict=True))
    found += [(edges[s][0], edges[e - 1][1]) for s, e in zip(passages[::2], passages[1::2], strict=True)]
    out: list[int] = []
    for s, e in sorted(found):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def drop_repeats(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int | None = None, length: int = LENGTH, **settings) -> DataFrame:
    """The documents with their remaining text. Incomplete characters at cuts go; untouched texts stay as they are. With
    ``words``, passages of so many words that occur again go as well, however few bytes they have (blanks between words
    may differ)."""
    spans = free_name(documents.columns, "spans")
    passages = free_name([*documents.columns, spans], "passages")
    if words:
        found = repeats(documents, doc_id, text, length, words, spans=spans, passages=passages, **settings)
    else:
        found = repeated_spans(documents, doc_id, text, length, out=spans, **settings)
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            gone, texts = batch.column(spans).to_pylist(), raw_bytes(batch.column(text)).to_pylist()
            if words:
                gone = [_with_passages(x, s, p) if p else s for x, s, p in zip(texts, gone, batch.column(passages).to_pylist(), strict=True)]
            texts = [_kept(x, s).decode("utf-8", "ignore").encode() if s else x for x, s in zip(texts, gone, strict=True)]
            done = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([done if n == text else batch.column(n) for n in schema.names], names=schema.names)

    return found.mapInArrow(lean(run), schema)
