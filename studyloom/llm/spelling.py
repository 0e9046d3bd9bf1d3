"""Spelling variants by a symmetric-delete join.

Every word emits its own key and one for each of its distinct single deletions. Two words that differ by one inserted,
deleted or replaced character share a key, so an equi-join over keys finds all candidates; a candidate stands if the exact
distance is one. A key is a 64-bit hash: of the sum of its characters' random values times powers of an odd number, so
that a deletion takes a step and not a copy, and a word of a million letters sends a million numbers instead of a million
words. Keys that agree by chance only add candidates. The words themselves are joined to distinct candidates alone.

A word's form is its near word with the largest count, if that is at least ``FORM_TIMES`` its own. Counts grow by that
factor along a chain of forms, so roots are found in a few rounds, each of which doubles the steps taken.

Runs of letters are counted in the tasks before anything is shuffled. A key's group holds words that differ in one place,
so its size is bounded by their lengths times the letters; AQE splits what is uneven. All tables grow with the texts, so none
is broadcast.

Defined results: a null text has no words; rows repeated are counted again; equal counts go to the smaller word by code
points; a word without near words is its own root; an empty table gives an empty result; other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, raw_bytes, shuffled, slices, written

MIN_LENGTH, MIN_COUNT, FORM_TIMES, MISSPELT_EVERY = 7, 2, 10, 31
#: Distinct words, and their bytes, that a task holds before it hands on their counts.
HELD, HELD_BYTES = 200_000, 16 << 20
#: Letters whose keys are made at once.
SLICE_LETTERS = 1 << 18

#: Runs of a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"[a-z]+(?:\xc3[\x80-\xbf][a-z]*)*|(?:\xc3[\x80-\xbf][a-z]*)+")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

_TIMES = xxhash.xxh64_intdigest("times") | 1
_BACK = pow(_TIMES, -1, 1 << 64)


def word_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", misspelt_every: int | None = None, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n) of the runs of letters of all texts, A-Z in lower case, of at least ``min_length`` characters.

    ``misspelt_every``: plants misspellings. If it divides h, the CRC-32 of ``<doc_id>:<run>``, the run loses its
    character at h modulo its length; nothing is planted in rows without an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        size = 0
        for batch in slices(batches, "text"):
            for name, x in zip(batch.column("id").to_pylist(), raw_bytes(batch.column("text")).to_pylist(), strict=True):
                own = Counter(r for r in _RUN.findall((x or b"").translate(_LOWER)) if len(r) >= min_length)
                start = None if misspelt_every is None or name is None else zlib.crc32(f"{name}:".encode())
                for word, n in own.items():
                    if start is not None and (h := zlib.crc32(word, start)) % misspelt_every == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        letters = letters[:at] + letters[at + 1 :]
                        word = letters.encode()
                        long_enough = len(letters) >= min_length
                    else:
                        # A character has two bytes at most, so only words below twice the length need a look.
                        long_enough = len(word) >= 2 * min_length or len(word.decode()) >= min_length
                    if long_enough:
                        size += len(word)
                        held[word] += n
                if len(held) > HELD or size > HELD_BYTES:
                    yield rows()
                    size = 0
        yield rows()

    found = documents.select(F.col(f"`{doc_id}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    return found.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _values(letters: np.ndarray) -> np.ndarray:
    """A random-looking 64-bit value of each code point."""
    x = (letters.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, key) of all words and their distinct single deletions."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(letters)) - starts[owner]
    powers = np.ones(int(sizes.max(initial=0)) + 1, np.uint64)
    powers[1:] = _TIMES
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(_values(letters) * powers[place])])
    # Of a run of one letter, each deletion gives the same string.
    fresh = place == 0
    fresh[1:] |= letters[1:] != letters[:-1]
    at = np.flatnonzero(fresh)
    own = owner[at]
    without = sums[at] - sums[starts[own]] + (sums[ends[own]] - sums[at + 1]) * np.uint64(_BACK)
    return np.concatenate([np.arange(len(words)), own]), np.concatenate([sums[ends] - sums[starts], without])


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): numbers of all words at a distance of exactly one, each pair once. ``words``: distinct (wid, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word", SLICE_LETTERS):
            place, key = deletion_keys(batch.column("word").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("wid").to_numpy()[place]), pa.array(key.view(np.int64))], names=["wid", "key"])

    keys = words.select("wid", "word").mapInArrow(lean(run), "wid long, key long")
    # Most keys belong to one word only and needn't be joined.
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    keys = written(keys.join(shuffled(shared), "key"), "spelling-keys")
    left, right = keys.select("key", F.col("wid").alias("a")), keys.select("key", F.col("wid").alias("b"))
    pairs = written(left.join(shuffled(right), "key").where("a < b").select("a", "b").distinct(), "spelling-pairs")
    named = lambda end: shuffled(words.select(F.col("wid").alias(end), F.col("word").alias(f"word_{end}")))
    whole = pairs.join(named("a"), "a").join(named("b"), "b")
    return whole.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def variants(counts: DataFrame, form_times: int = FORM_TIMES, min_count: int = MIN_COUNT) -> DataFrame:
    """Each word of at least ``min_count`` (word, n) with ``n_near``, its ``form`` and ``form_n`` (null if none) and its
    ``root``, the last of its chain of forms."""
    words = written(counts.where(F.col("n") >= min_count).withColumn("wid", F.monotonically_increasing_id()), "spelling-words")
    links = written(near_pairs(words), "spelling-links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("wid").alias("b"), F.struct((-F.col("n")).alias("less"), "word", "wid").alias("near"))
    best = both.join(shuffled(other), "b").groupBy("a").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    placed = words.join(shuffled(best), words.wid == best.a, "left").drop("a").withColumn("n_near", F.coalesce("n_near", F.lit(0).cast("long")))
    formed = F.when(-F.col("near.less") >= F.lit(form_times) * F.col("n"), F.col("near"))
    placed = written(placed.withColumn("form", formed).drop("near"), "spelling-forms")

    # steps: (wid, to) for words with a form; each round follows as many steps again.
    steps = placed.where("form is not null").select("wid", F.col("form.wid").alias("to"))
    while True:
        further = steps.select(F.col("wid").alias("to"), F.col("to").alias("next"))
        steps = written(steps.join(shuffled(further), "to", "left").select("wid", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if steps.where("moved").isEmpty():
            break
        steps = steps.drop("moved")
    roots = steps.select("wid", F.col("to").alias("root_id")).join(shuffled(words.select(F.col("wid").alias("root_id"), F.col("word").alias("root"))), "root_id").select("wid", "root")
    return placed.join(shuffled(roots), "wid", "left").select(
        "word",
        "n",
        "n_near",
        F.col("form.word").alias("form"),
        (-F.col("form.less")).alias("form_n"),
        F.coalesce("root", "word").alias("root"),
    )
