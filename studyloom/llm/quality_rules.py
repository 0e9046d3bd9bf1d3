"""Quality rules: base rules of a text, and how far its histograms are from those of its language.

Two histograms of a document are compared with its language's reference by the Jensen-Shannon distance (base 2, so from 0
to 1): code points by character class, and words by the language's ``COMMON`` commonest words (all others are one bin). A
reference is the mean of its documents' shares, over all documents that pass the base rules, so a long document weighs as
much as a short one. Short texts are far from any reference by chance: below ``CHAR_GUARD`` code points or ``WORD_GUARD``
words a histogram isn't judged, and above that the limit has a margin that falls with the root of the length.

A document whose language is null or has no reference is compared with all of them and judged by the nearest. References
are of the ``LANGUAGES`` languages with the most documents, so what tasks get of them is bounded.

Work: one pass counts words by language (pre-aggregated in the tasks), one counts everything about a document, and the
distances are computed over the counts, which hold no text.

Defined results: a null text has no words, fails the base rules and isn't kept; repeated rows are judged alike; equal
counts of words are settled by the word's bytes; an empty table gives an empty result; of other columns those in ``keep``
pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import lean, raw_bytes, slices, written

MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 10, 5, 20
COMMON, LANGUAGES = 64, 64
CHAR_GUARD, WORD_GUARD = 60, 40
CHAR_LIMIT, CHAR_MARGIN, WORD_LIMIT, WORD_MARGIN = 0.12, 3.0, 0.15, 2.3
SYMBOLS = "#*$%&|<>"
#: Code points by their first byte in UTF-8: a-z, A-Z, 0-9, white space, marks of sentences, shouting, symbols, other
#: ASCII, up to U+027F, all others.
CLASSES = 10
#: Distinct words that a task holds before it hands on their counts.
HELD = 200_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _class_table() -> np.ndarray:
    """The class of every byte; bytes inside a code point have one class more, which isn't counted."""
    table = np.full(256, 7, np.int64)
    for k, members in ((0, range(97, 123)), (1, range(65, 91)), (2, range(48, 58)), (3, (32, *range(9, 14))), (4, b".,;:'\"()-"), (5, b"!?"), (6, SYMBOLS.encode()), (8, range(0xC0, 0xCA)), (9, range(0xCA, 0x100)), (10, range(0x80, 0xC0))):
        table[list(members)] = k
    return table


_TABLE = _class_table()


def repeated_places(ids: np.ndarray, owner: np.ndarray, size: int = REPEAT_WINDOW) -> np.ndarray:
    """Which words stand in a window of ``size`` words that its owner holds twice or more. Words of one owner are together."""
    hit = np.zeros(len(ids), bool)
    n = len(ids) - size + 1
    if n < 2:
        return hit
    name = ids.astype(np.int64)
    # Names of growing windows: (window so far, next word) is renamed to a dense number, so equal names are equal windows.
    for i in range(1, size):
        pairs = name[: len(ids) - i] * (int(ids.max()) + 1) + ids[i:]
        name = np.unique(pairs, return_inverse=True)[1]
    whole = np.flatnonzero(owner[:n] == owner[size - 1 :])
    keys = owner[whole] * (int(name.max()) + 1) + name[whole]
    _, at, times = np.unique(keys, return_inverse=True, return_counts=True)
    starts = whole[times[at] > 1]
    for i in range(size):
        hit[starts + i] = True
    return hit


def _word_counts(documents: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n) of lower-cased words (A-Z only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Counter] = defaultdict(Counter)

        def rows() -> Iterator[pa.RecordBatch]:
            for name, words in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(words), pa.string()), pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in slices(batches, "text", 2 << 20):
            for name, x in zip(batch.column("lang").to_pylist(), raw_bytes(batch.column("text")).to_pylist(), strict=True):
                if x:
                    held[name].update(x.translate(_LOWER).split())
            if sum(map(len, held.values())) > HELD:
                yield from rows()
        yield from rows()

    found = documents.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang is not null")
    return found.mapInArrow(lean(run), "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def common_words(documents: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[bytes]]:
    """The commonest words of the languages with the most documents."""
    named = documents.select(F.col(f"`{lang}`").cast("string").alias("lang")).where("lang is not null")
    most = named.groupBy("lang").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "lang").limit(LANGUAGES)
    langs = [r.lang for r in most.collect()]
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = _word_counts(documents, text, lang).where(F.col("lang").isin(langs)).withColumn("place", place).where(F.col("place") <= COMMON)
    out: dict[str, list[bytes]] = {x: [] for x in sorted(langs)}
    for r in sorted(top.collect(), key=lambda r: (r.lang, r.place)):
        out[r.lang].append(bytes(r.word))
    return out


def with_counts(documents: DataFrame, common: dict[str, list[bytes]], text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """One struct column ``row`` of the columns ``keep`` (or all), ``lang``, the base counts, and the histograms ``chars`` and
    ``words`` (one after another for every language that the document is compared with)."""
    names = list(common)
    keep = documents.columns if keep is None else keep
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([rows.schema["row"], T.StructField("lang", T.StringType()), *(T.StructField(c, T.LongType()) for c in counts), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("chars", "words"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = {name: {w: i for i, w in enumerate(words)} for name, words in common.items()}
        for batch in slices(batches, "text", 4 << 20):
            texts = [x or b"" for x in raw_bytes(batch.column("text")).to_pylist()]
            seen: dict[bytes, int] = defaultdict(count().__next__)
            split = [x.split() for x in texts]
            sizes = np.array([len(x) for x in split], np.int64)
            ids = np.fromiter((seen[w] for x in split for w in x), np.int64, int(sizes.sum()))
            del split
            ends = np.cumsum(sizes)
            owner = np.repeat(np.arange(len(texts)), sizes)
            repeated = np.bincount(owner[repeated_places(ids, owner)], minlength=len(texts))
            lowered = [w.translate(_LOWER) for w in seen]
            bin_of = {name: np.array([x.get(w, COMMON) for w in lowered], np.int64) for name, x in bins.items()}
            out: list[list] = [[] for _ in range(5)]
            for i, x in enumerate(texts):
                classes = np.bincount(_TABLE[np.frombuffer(x, np.uint8)], minlength=CLASSES + 1)[:CLASSES]
                lines = [y for y in x.split(b"\n") if y.strip()]
                own = ids[ends[i] - sizes[i] : ends[i]]
                known = batch.column("lang")[i].as_py()
                words = [np.bincount(bin_of[name][own], minlength=COMMON + 1) for name in ([known] if known in bins else names)]
                for column, value in zip(out, (int(classes.sum() - classes[3]), int(classes[6]), len(lines) - len(set(lines)), classes.tolist(), np.concatenate(words).tolist() if words else []), strict=True):
                    column.append(value)
            longs = [pa.array(c, pa.int64()) for c in (sizes, out[0], out[1], out[2], repeated)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("lang"), *longs, pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64()))], names=schema.names)

    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(lean(run), schema).withColumn("base_failed", failed)


def references(counted: DataFrame, names: list[str]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """The mean shares (classes, words) of each language's documents that pass the base rules. A language without any has
    no reference."""
    good = counted.where(~F.col("base_failed")).where(F.col("lang").isin(names))

    def shares(kind: str) -> DataFrame:
        total = F.aggregate(kind, F.lit(0).cast("long"), lambda a, x: a + x)
        # Millionths, so that sums don't depend on their order.
        each = good.select("lang", F.posexplode(F.transform(kind, lambda x: F.floor(x * F.lit(1_000_000) / total))).alias("bin", "share"))
        return each.groupBy("lang", "bin").agg(F.sum("share").alias("share")).withColumn("kind", F.lit(kind))

    sizes = {"chars": CLASSES, "words": COMMON + 1}
    found: dict[str, dict[str, np.ndarray]] = defaultdict(lambda: {k: np.zeros(n) for k, n in sizes.items()})
    for r in shares("chars").unionByName(shares("words")).collect():
        found[r.lang][r.kind][r.bin] = r.share
    return {name: (x["chars"] / x["chars"].sum(), x["words"] / x["words"].sum()) for name, x in sorted(found.items())}


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """The Jensen-Shannon distance of each row's shares to the reference; 0 for a row of zeros."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + reference) / 2

    def divergence(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    both = (divergence(p) + divergence(np.broadcast_to(reference, p.shape))) / 2
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum(both, 0)), 0)


def judged(counted: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]], names: list[str]) -> DataFrame:
    """The counted rows with ``char_distance``, ``word_distance`` (to the reference of least sum) and ``kept``."""
    schema = T.StructType([*counted.schema.fields, T.StructField("char_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    size = COMMON + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            langs = batch.column("lang").to_pylist()
            chars = np.array(batch.column("chars").to_pylist(), np.int64).reshape(n, CLASSES)
            best = np.full((n, 3), np.inf)
            lists = batch.column("words")
            flat, starts = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for name, (char_ref, word_ref) in known.items():
                # A document of a known language holds that language's histogram alone, any other those of all languages.
                own = np.array([x == name or x not in known for x in langs], bool)
                at = np.flatnonzero(own)
                if not len(at):
                    continue
                shift = np.array([0 if langs[i] in names else names.index(name) * size for i in at])
                alone = np.array([langs[i] in names and langs[i] != name for i in at], bool)
                words = flat[(starts[at] + shift)[:, None] + np.arange(size)]
                # A named language without a reference has counts of its own words only; its words aren't judged.
                far = np.where(alone, 0, distances(words, word_ref))
                near = distances(chars[at], char_ref)
                better = near + far < best[at, 0]
                best[at[better]] = np.stack([near + far, near, far], axis=1)[better]
            best[np.isinf(best[:, 0])] = 0
            n_chars, n_words = chars.sum(axis=1), batch.column("n_words").to_numpy()
            odd = (n_chars >= CHAR_GUARD) & (best[:, 1] > CHAR_LIMIT + CHAR_MARGIN / np.sqrt(np.maximum(n_chars, 1)))
            odd |= (n_words >= WORD_GUARD) & (best[:, 2] > WORD_LIMIT + WORD_MARGIN / np.sqrt(np.maximum(n_words, 1)))
            kept = ~(odd | batch.column("base_failed").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best[:, 1]), pa.array(best[:, 2]), pa.array(kept)], names=schema.names)

    return counted.mapInArrow(lean(run), schema)


def judge(documents: DataFrame, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Every document (``row``: its columns ``keep``, or all) with base counts, ``base_failed``, both distances and ``kept``."""
    common = common_words(documents, text, lang)
    names = list(common)
    counted = written(with_counts(documents, common, text, lang, keep), "quality-counts")
    return judged(counted, references(counted, names), names)
