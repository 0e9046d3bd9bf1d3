"""Hierarchical multi-length packing of tokenised documents.

Context sizes are tiers (powers of two). A document gives the longest tier as many full windows as it fills; the rest
goes to the shortest tier that holds it. In each tier the rests are laid one after the other into windows of the
tier's size, cutting where a window is full. What is left in a tier's last, unfilled window fills gaps one tier up:
left-overs go upward until the longest tier, whose last window is closed by exact windows of the shorter tiers in
descending order, so it needs no padding but for a remainder below the shortest tier.

Every task packs the documents it reads (level 1) and hands on its remainder, less than one shortest window. Groups of
tasks' remainders are packed together (level 2), so that padding is at most one window for each of those few groups.
No shuffle moves texts; only remainders (a few pieces a task) move. Windows of one tier are dealt to as few step groups
of at most ``step_tokens`` tokens as hold them, over all tasks, so that groups of a tier differ by one window at most.

Defined results: null and empty texts are the end id alone; repeated rows are packed each; a null document id stays
null; columns besides id and text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, raw_bytes, slices, written
from .word_ids import encoder

TIERS = (512, 1024, 2048, 4096)
#: Tokens of one step group: so many windows of any one tier.
STEP_TOKENS = 1 << 16
#: Remainders of about so many level-1 tasks are packed together.
FAN_IN = 64
#: Sequences of one task or group of remainders are numbered in so many bits.
UNIT_BITS = 36

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_COLUMNS = [c.split()[0] for c in PIECE.split(", ")]
_ARROW = pa.schema([(n, pa.int32() if n == "tier" else pa.int64()) for n in _COLUMNS])


class Packer:
    """Windows of one task. A piece is [doc, start, ids, document's ids] until its window is full."""

    def __init__(self, tiers: tuple[int, ...], first_sequence: int):
        self.tiers, self.next = tiers, first_sequence
        self.open: dict[int, list] = {t: [] for t in tiers}
        self.filled = dict.fromkeys(tiers, 0)
        self.made = dict.fromkeys(tiers, 0)
        self.rows: list[tuple] = []

    def add(self, doc: int | None, start: int, ids: np.ndarray, total: int) -> None:
        longest, at = self.tiers[-1], 0
        while len(ids) - at >= longest:
            self._emit([(doc, start + at, ids[at : at + longest], total)], longest)
            at += longest
        if at < len(ids):
            rest = ids[at:]
            self._lay(next(t for t in self.tiers if len(rest) <= t), doc, start + at, rest, total)

    def _lay(self, tier: int, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            n = min(len(ids), tier - self.filled[tier])
            self.open[tier].append((doc, start, ids[:n], total))
            self.filled[tier] += n
            if self.filled[tier] == tier:
                self._emit(self.open[tier], tier)
                self.open[tier], self.filled[tier] = [], 0
            start, ids = start + n, ids[n:]

    def _emit(self, pieces: list, tier: int) -> None:
        nth, offset = self.made[tier], 0
        self.made[tier] += 1
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset, tier, nth))
            offset += len(ids)
        self.next += 1

    def close(self) -> list:
        """Raise left-overs tier by tier, close the longest tier by exact shorter windows; the remainder's pieces."""
        pieces: list = []
        for tier in self.tiers:
            pieces, self.open[tier], self.filled[tier] = self.open[tier] + pieces, [], 0
        left = sum(len(p[2]) for p in pieces)
        for tier in reversed(self.tiers):
            while left >= tier:
                taken, need = [], tier
                while need:
                    doc, start, ids, total = pieces.pop(0)
                    n = min(need, len(ids))
                    taken.append((doc, start, ids[:n], total))
                    if n < len(ids):
                        pieces.insert(0, (doc, start + n, ids[n:], total))
                    need -= n
                self._emit(taken, tier)
                left -= tier
        return pieces

    def drain(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) if self.rows else [[] for _ in _COLUMNS]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(documents: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """A row for each piece: document id, first id, length, CRC-32 of its ids, the document's ids, sequence, offset in
    the sequence, tier and step group. Sequences hold at most the longest tier."""
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are ascending powers of two")
    spark = documents.sparkSession

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer, part = encoder(tokenizer), None, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", 2 << 20):
            if packer is None:
                part = batch.column("part")[0].as_py()
                packer = Packer(tiers, part << UNIT_BITS)
            texts = [(x or b"").decode("utf-8", "replace") for x in raw_bytes(batch.column("text")).to_pylist()]
            for i, raw in zip(batch.column("doc_id").to_pylist(), model.encode(texts), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                packer.add(i, 0, ids, len(ids))
            yield _with_ids(packer.drain(), None, part)
        if packer is not None:
            rest = packer.close()
            yield _with_ids(packer.drain(), None, part)
            if rest:
                open_rows = [(d, s, len(x), 0, n, 0, 0, 0, 0) for d, s, x, n in rest]
                packer.rows = open_rows
                yield _with_ids(packer.drain(), [x.tobytes() for _, _, x, _ in rest], part)

    rows = documents.select(F.spark_partition_id().alias("part"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packed = written(rows.mapInArrow(lean(first_level), f"{PIECE}, ids binary, part int"), "packed")

    def second_level(key, table):
        table = table.sort_by([("part", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        packer = Packer(tiers, (1 << 62) + (key[0].as_py() << UNIT_BITS))
        for d, s, raw, n in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True):
            packer.add(d, s, np.frombuffer(raw, "<u4"), n)
        if rest := packer.close():
            packer._emit(rest, tiers[-1])
        return pa.Table.from_batches([packer.drain()])

    closed = packed.where("ids is null").select(*_COLUMNS)
    opened = packed.where("ids is not null").withColumn("fan", F.expr(f"cast(part div {FAN_IN} as long)"))
    tails = written(opened.groupBy("fan").applyInArrow(second_level, PIECE), "tails")
    return _with_step_groups(closed.unionByName(tails), tiers, step_tokens)


def _with_step_groups(pieces: DataFrame, tiers: tuple[int, ...], step_tokens: int) -> DataFrame:
    """``pieces``, whose ``step_group`` counts the windows of a tier within a task, with groups over all tasks. Counts are a row
    for each task and tier; they are written, so that the join knows their true size."""
    unit = F.shiftright("sequence_id", UNIT_BITS)
    counts = written(pieces.groupBy(unit.alias("unit"), F.col("tier").alias("size")).agg((F.max("step_group") + 1).alias("n")), "windows")
    by = Window.partitionBy("size")
    before = F.coalesce(F.sum("n").over(by.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counts.select("unit", "size", before.alias("before"), F.sum("n").over(by).alias("windows"))
    placed = placed.withColumn("groups", F.least("windows", F.ceil(F.col("windows") * F.col("size") / step_tokens)))
    number = F.expr("(before + step_group) * groups div windows")
    rank = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1
    joined = pieces.join(placed, (unit == F.col("unit")) & (F.col("tier") == F.col("size")))
    return joined.withColumn("step_group", number * len(tiers) + rank).select(*_COLUMNS)


def _with_ids(batch: pa.RecordBatch, ids: list[bytes] | None, part: int) -> pa.RecordBatch:
    n = batch.num_rows
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids or [None] * n, pa.binary()), pa.array([part] * n, pa.int32())], names=[*_COLUMNS, "ids", "part"])
