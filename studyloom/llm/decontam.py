"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Documents stream through the automaton word by word; it yields at every word the longest item passage that ends
there. A passage of ``window`` item words (an item with fewer words counts as one window) marks its words as hit.

Defined results: null and wordless texts have no words and no hits; items without words are ignored; repeated items
each count; an item without an id marks words, but isn't named; repeated documents each get a row; other columns of the
documents pass through untouched.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, lean, raw_bytes, slices, written

WINDOW = 10
#: Words of the items of one pass over the documents. An automaton has at most two states and three edges a word, about
#: 60 bytes a word in a task.
BLOCK_WORDS = 1 << 20
#: Words of one automaton: while it is built, its dictionaries take about 1 kB a word on the driver.
PART_WORDS = 1 << 17

# Every byte outside words becomes a space, A-Z becomes a-z; bytes from 0x80 on belong to words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def runs_of(mask: np.ndarray) -> list[int]:
    """First and last-plus-one positions of the runs of true values, flattened."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()


class _Lists:
    """Lists of numbers by state, in flat arrays."""

    def __init__(self, lists: dict[int, list[int]]):
        self.keys = array("i", sorted(lists))
        self.starts, self.values = array("i", [0]), array("i")
        for k in self.keys:
            self.values.extend(lists[k])
            self.starts.append(len(self.values))

    def __getitem__(self, key: int) -> array:
        i = bisect_left(self.keys, key)
        return self.values[self.starts[i] : self.starts[i + 1]]


class ItemAutomaton:
    """Generalised suffix automaton over word ids, with the items of every window. It is built with dictionaries and kept
    in flat arrays: the edges are sorted numbers of state and word, their targets beside them."""

    def __init__(self, items: list[tuple[int, list[int]]], window: int = WINDOW):
        self.window = window
        self._step: list[dict[int, int]] = [{}]
        self._link, self._length = [-1], [0]
        ends = []
        for item, ids in items:
            state, path = 0, []
            for w in ids:
                state = self._extend(state, w)
                path.append(state)
            ends.append((item, path))
        self._mark(ends)
        edges = sorted((s << 32 | w, q) for s, out in enumerate(self._step) for w, q in out.items())
        self.edges, self.targets = array("q", (e for e, _ in edges)), array("i", (q for _, q in edges))
        self.link, self.length = array("i", self._link), array("i", self._length)
        del self._step, self._link, self._length

    def _extend(self, last: int, w: int) -> int:
        step, link, length = self._step, self._link, self._length
        if (q := step[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, q, w)
        new = self._state({}, -1, length[last] + 1)
        p = last
        while p != -1 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = step[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
        return new

    def _state(self, step: dict[int, int], link: int, length: int) -> int:
        self._step.append(step)
        self._link.append(link)
        self._length.append(length)
        return len(self._step) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        step, link = self._step, self._link
        copy = self._state(dict(step[q]), link[q], self._length[p] + 1)
        link[q] = copy
        while p != -1 and step[p].get(w) == q:
            step[p][w] = copy
            p = link[p]
        return copy

    def _mark(self, ends: list[tuple[int, list[int]]]) -> None:
        """full[state]: the suffix state whose strings include the window ending there; short: whole short items."""
        n, link, length, window = len(self._step), self._link, self._length, self.window
        order = sorted(range(n), key=length.__getitem__)
        full = [-1] * n
        for s in order:
            if length[s] >= window:
                full[s] = s if length[link[s]] < window else full[link[s]]
        items: dict[int, list[int]] = {}
        whole: dict[int, list[int]] = {}
        for item, path in ends:
            if len(path) < window:
                whole.setdefault(path[-1], []).append(item)
            for s in {full[s] for s in path} - {-1}:
                items.setdefault(s, []).append(item)
        #: short[state]: the longest suffix state that is a whole short item, itself included.
        short = [-1] * n
        for s in order[1:]:
            short[s] = s if s in whole else short[link[s]]
        self.full, self.short, self.items, self.whole = array("i", full), array("i", short), _Lists(items), _Lists(whole)

    def _next(self, state: int, w: int) -> int:
        edge = state << 32 | w
        i = bisect_left(self.edges, edge)
        return self.targets[i] if i < len(self.edges) and self.edges[i] == edge else -1

    def stream(self, ids: list[int], first: int, hit: np.ndarray, found: set[int]) -> None:
        """Marks the hit words of the run ``ids``, which begins at ``first``, and adds the items whose windows occur."""
        follow, link, length, window = self._next, self.link, self.length, self.window
        state = matched = 0
        for i, w in enumerate(ids, first + 1):
            while (q := follow(state, w)) < 0 and state:
                state = link[state]
                matched = length[state]
            if q >= 0:
                state, matched = q, matched + 1
            if matched >= window:
                hit[i - window : i] = True
                found.update(self.items[self.full[state]])
            s = self.short[state]
            if s == state and matched < length[s]:  # only a shorter string of that state has matched
                s = self.short[link[s]]
            while s != -1:
                hit[i - length[s] : i] = True
                found.update(self.whole[s])
                s = self.short[link[s]]


class ItemBlock:
    """Items of a bounded number of words: automata of at most ``part`` words each over one vocabulary. ``items``: names
    and word lists."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW, part: int = PART_WORDS):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        ids = [[self.vocab.setdefault(w, len(self.vocab)) for w in words] for _, words in items]
        self.least = min([window, *map(len, ids)])
        pairs = [np.unique(np.array(x[:-1], np.int64) << 32 | np.array(x[1:], np.int64)) for x in ids]
        self.pairs = np.unique(np.concatenate([np.empty(0, np.int64), *pairs]))
        self.automata = [ItemAutomaton(some, window) for some in _filled(enumerate(ids), part)]

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Runs of neighbouring words that can hold a window: all in the vocabulary, each pair of them in an item."""
        known = ids >= 0
        joined = np.zeros(max(len(ids) - 1, 0), bool)
        if len(self.pairs):
            pair = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = (self.pairs[at] == pair) & known[:-1] & known[1:]
        edge = runs_of(joined)
        runs = [(a, b + 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if b + 1 - a >= self.least]
        if self.least == 1:
            alone = known.copy()
            for a, b in runs:
                alone[a:b] = False
            runs += [(i, i + 1) for i in np.flatnonzero(alone).tolist()]
        return runs

    def search(self, words: list[bytes]) -> tuple[np.ndarray, list[str]]:
        """Which words are hit, and the names of the items whose windows occur, sorted."""
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int64, len(words))
        hit, found = np.zeros(len(ids), bool), set()
        for a, b in self.candidates(ids):
            run = ids[a:b].tolist()
            for automaton in self.automata:
                automaton.stream(run, a, hit, found)
        return hit, sorted({self.names[f] for f in found} - {None})


def _filled(items: Iterable[tuple], limit: int) -> Iterator[list[tuple]]:
    """Consecutive items in lists whose second fields have at most ``limit`` elements in all, or one item."""
    held, n = [], 0
    for item in items:
        if held and n + len(item[1]) > limit:
            yield held
            held, n = [], 0
        held.append(item)
        n += len(item[1])
    if held:
        yield held


def _parts(benchmark: DataFrame, item: str, text: str, window: int, part: int) -> Iterator[tuple[str | None, list[bytes]]]:
    """Names and words of the items, read partition by partition. An item of more than ``part`` words comes in pieces that
    overlap by a window less a word, so that they have the same windows."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.encode(F.col(text), "UTF-8").alias("t")).where("t is not null")
    stride = max(part - window + 1, 1)
    for r in rows.toLocalIterator():
        words = words_of(bytes(r.t))
        for start in range(0, max(len(words) - window + 1, 1), stride):
            if some := words[start : start + stride + window - 1]:
                yield r.i, some


def _word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the words, for the few documents that are hit."""
    return list(_pairs(runs_of(np.frombuffer(text.translate(_FOLD), np.uint8) != 32)))


_HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hit_spans", T.ArrayType(T.LongType())),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
    ]
)


def find_contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """The documents (their columns ``keep``, or all) with ``n_words``, ``hit_spans`` (first and last-plus-one word of each hit run, flattened) and
    ``item_ids`` (distinct, sorted as strings). One pass without a shuffle for items of up to ``block_words`` words. Of a
    larger benchmark every block of so many words has a pass over the texts; only hits are written in between and joined
    to numbered rows. Columns with the names of the three (after ``prefix``) are replaced."""
    names = [prefix + f.name for f in _HITS]
    keep = [c for c in (documents.columns if keep is None else keep) if c not in names]
    part = max(min(PART_WORDS, block_words), window)
    blocks = _filled(_parts(benchmark, item_id, item_text, window, part), block_words)
    block, after = next(blocks, []), next(blocks, None)
    if after is None:
        return _searched(documents, text, keep, block, window, names)
    # Rows travel as one column, so that no name of theirs can clash.
    numbered = written(documents.select(F.struct(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, text]))).alias("row"), F.monotonically_increasing_id().alias("rid")), "decontam-rows")
    texts, passes = numbered.select("rid", F.col("row")[text].alias("text")), []
    while block is not None:
        hits = _searched(texts, "text", ["rid"], block, window, _HITS.names)
        passes.append(written(hits if not passes else hits.where("size(hit_spans) > 0"), "decontam-hits"))
        block, after = after, next(blocks, None)
    found = reduce(DataFrame.unionByName, passes).groupBy("rid").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hit_spans")).alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    merged = found.mapInArrow(_merge, T.StructType([T.StructField("rid", T.LongType()), *_HITS]))
    return numbered.join(merged, "rid").select(*(F.col("row")[c].alias(c) for c in keep), *(F.col(f.name).alias(n) for f, n in zip(_HITS, names, strict=True)))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping spans of several passes become runs."""
    for batch in batches:
        runs = []
        for flat in batch.column("hit_spans").to_pylist():
            spans: list[int] = []
            for s, e in sorted(_pairs(flat)):
                if spans and s <= spans[-1]:
                    spans[-1] = max(spans[-1], e)
                else:
                    spans += [s, e]
            runs.append(spans)
        yield batch.set_column(batch.schema.get_field_index("hit_spans"), "hit_spans", pa.array(runs, pa.list_(pa.int64())))


def _searched(documents: DataFrame, text: str, keep: list[str], items: list[tuple], window: int, names: list[str]) -> DataFrame:
    """The columns ``keep`` of the documents and what one block of items has in them."""
    shared = documents.sparkSession.sparkContext.broadcast(ItemBlock(items, window))
    schema = T.StructType([*(documents.schema[c] for c in keep), *(T.StructField(n, f.dataType) for f, n in zip(_HITS, names, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in slices(batches, text):
            n_words, spans, found = [], [], []
            for x in raw_bytes(batch.column(text)).to_pylist():
                words = words_of(x or b"")
                hit, ids = block.search(words)
                n_words.append(len(words))
                spans.append(runs_of(hit))
                found.append(ids)
            hits = (pa.array(v, t) for v, t in zip((n_words, spans, found), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())), strict=True))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *hits], names=schema.names)

    return documents.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), schema)


def _pairs(flat: list[int]) -> Iterator[tuple[int, int]]:
    return zip(flat[::2], flat[1::2], strict=True)


def decontaminate(documents: DataFrame, benchmark: DataFrame, text: str = "text", min_words: int = WINDOW, coverage: float = 0.5, **settings) -> DataFrame:
    """The documents without their hit spans of at least ``min_words`` words, and without the documents of which more
    than ``coverage`` of the words are hit. Texts without such spans stay as they are."""
    prefix = "_"
    while any(free_name(documents.columns, prefix + f.name) != prefix + f.name for f in _HITS.fields):
        prefix += "_"
    hits = find_contamination(documents, benchmark, text, prefix=prefix, **settings)
    schema = documents.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            kept, texts = [], []
            for i, (x, flat, n) in enumerate(zip(raw_bytes(batch.column(text)).to_pylist(), batch.column(f"{prefix}hit_spans").to_pylist(), batch.column(f"{prefix}n_words").to_pylist(), strict=True)):
                spans = list(_pairs(flat))
                if sum(e - s for s, e in spans) > coverage * n:
                    continue
                if spans := [(s, e) for s, e in spans if e - s >= min_words]:
                    at, last, parts = _word_spans(x), 0, []
                    for s, e in spans:
                        parts.append(x[last : at[s][0]])
                        last = at[e - 1][1]
                    x = b"".join([*parts, x[last:]])
                kept.append(i)
                texts.append(x)
            out = batch.take(pa.array(kept, pa.int64()))
            done = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([done if n == text else out.column(n) for n in schema.names], names=schema.names)

    return hits.mapInArrow(lean(run), schema)
