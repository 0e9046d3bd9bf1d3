"""Token counts by rank-synchronous merging of byte-pair encodings in numpy.

Pre-tokens of a batch lie in one ragged array (symbols plus the start of every sequence). Each round finds, for every
sequence at once, its lowest-ranked pair and merges all of that pair's occurrences from left to right, until no
sequence has a ranked pair; the surviving symbols are the tokens. That equals merging one pair at a time by (rank,
position), since a pair that contains a new symbol always has a higher rank than the merge that made the symbol.

Defined results: null and empty texts have no bytes and no tokens; strings of added special tokens inside a text
count as one token each, as the library does by default; other columns pass through.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import lean, raw_bytes, slices

#: A worker remembers the counts of distinct pre-tokens in about so many bytes of memory, then forgets them all.
REMEMBERED = 24 << 20
#: Bytes of a remembered pre-token besides its letters.
ENTRY = 150
#: Longer pre-tokens (in bytes) aren't remembered.
LONGEST = 64

# The byte-level pre-tokeniser's pattern, with Unicode's white space written out.
_WS = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class RankedMerges:
    """The merges of a byte-level tokenizer file as sorted arrays, and counts of tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        symbol = {bytes([b]): b for b in range(256)}
        pairs, made = [], []
        for left, right in spec["model"]["merges"]:
            a, b = (bytes(letters[c] for c in part) for part in (left, right))
            pairs.append(symbol[a] << 32 | symbol[b])
            made.append(symbol.setdefault(a + b, len(symbol)))
        order = np.argsort(np.array(pairs, np.int64), kind="stable")
        self.pairs, self.rank = np.array(pairs, np.int64)[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.held = 0

    def count_sequences(self, sequences: list[bytes]) -> np.ndarray:
        """Tokens of each byte sequence."""
        sizes = np.array([len(s) for s in sequences], np.int64)
        symbols = np.frombuffer(b"".join(sequences), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(sequences)), sizes)
        counts = np.zeros(len(sequences), np.int64)
        none = len(self.pairs)
        while len(symbols):
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), none - 1)
            ranks = np.where((self.pairs[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], none)
            ranks = np.append(ranks, none)  # the last symbol begins no pair
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lowest = np.minimum.reduceat(ranks, first)
            length = np.diff(np.append(first, len(symbols)))
            done = lowest == none
            counts[owner[first[done]]] = length[done]
            best = np.repeat(lowest, length)
            merge = (ranks == best) & (best < none)
            # Of overlapping occurrences in a row (only for a pair of equal symbols) every second is merged.
            start = merge & ~np.append(False, merge[:-1])
            place = np.arange(len(merge))
            since = place - np.maximum.accumulate(np.where(start, place, 0))
            merge &= since % 2 == 0
            symbols = np.where(merge, self.made[np.minimum(best, none - 1)], symbols)
            keep = ~np.append(False, merge[:-1]) & (best < none)
            symbols, owner = symbols[keep], owner[keep]
        return counts

    def count_texts(self, texts: list[str]) -> list[int]:
        parts: list[list[str]] = []
        extra: list[int] = []
        for text in texts:
            runs, n = [text], 0
            if self.special and self.special.search(text):
                runs = self.special.split(text)
                n = len(runs) - 1
            parts.append([w for run in runs for w in self.pattern.findall(run)])
            extra.append(n)
        known = self.known
        fresh = list({w for words in parts for w in words if w not in known})
        counts: dict[str, int] = {}
        if fresh:
            coded = [w.encode() for w in fresh]
            counts = dict(zip(fresh, self.count_sequences(coded).tolist(), strict=True))
            more = sum(ENTRY + len(w) for w in fresh if len(w) <= LONGEST)
            if self.held + more > REMEMBERED:
                known.clear()
                self.held = 0
                missing = list({w for words in parts for w in words if w not in counts})
                counts |= dict(zip(missing, self.count_sequences([w.encode() for w in missing]).tolist(), strict=True))
            if more <= REMEMBERED:
                known.update((w, counts[w]) for w in fresh if len(w) <= LONGEST)
                self.held += more
        get = lambda w: n if (n := known.get(w)) is not None else counts[w]
        out = []
        for words, n in zip(parts, extra, strict=True):
            try:
                out.append(n + sum(map(known.__getitem__, words)))
            except KeyError:
                out.append(n + sum(map(get, words)))
        return out


_LOADED: dict[str, RankedMerges] = {}


def merges(path: str) -> RankedMerges:
    """A worker's own copy, read once from the tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = RankedMerges(path)
    return _LOADED[path]


def with_token_counts(documents: DataFrame, path: str, text: str = "text", n_bytes: str = "n_bytes", n_tokens: str = "n_tokens", keep: list[str] | None = None) -> DataFrame:
    """The documents (their columns ``keep``, or all) with UTF-8 bytes and tokens of every whole text; no shuffle.
    ``path``: the tokenizer file, readable on every executor."""
    keep = [c for c in (documents.columns if keep is None else keep) if c not in (n_bytes, n_tokens)]
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField(n_bytes, T.LongType()), T.StructField(n_tokens, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for batch in slices(batches, text):
            column = raw_bytes(batch.column(text))
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).cast(pa.int64())
            counts = model.count_texts([(x or b"").decode("utf-8", "replace") for x in column.to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), sizes, pa.array(counts, pa.int64())], names=[*keep, n_bytes, n_tokens])

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), schema)
