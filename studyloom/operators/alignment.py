"""Alignment of two ordered sentence lists by balanced lengths, its flags, and the agreement of two alignments.

A piece is one row with both lists, so the dynamic programme runs where the row is, in Arrow batches without a shuffle;
everything after it is columns. Memory follows the longest piece (a byte for each pair of its sentences, or ``CELLS``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# Limits, penalties and thresholds of the alignment.
MAX_GROUP, MERGE_PENALTY, DRIFT_WEIGHT = 4, 0.4, 0.05
LOW_CONFIDENCE, LENGTH_TOLERANCE, AGREEMENT_FLOOR, CHUNK = 0.55, 2.0, 0.8, 30


#: Cells of the tables that are filled at once: a row of all of them should stay in a core's cache.
CELLS = 1 << 18


def _padded(lists: list[list[int]], width: int) -> np.ndarray:
    """Running sums of sizes (1 at least) of each list, from 0, going on by ones after its end."""
    sizes = np.ones((len(lists), width), np.int64)
    lengths = np.array([len(x) for x in lists])
    sizes[np.arange(width)[None, :] < lengths[:, None]] = np.maximum(1, np.fromiter((v for x in lists for v in x), np.int64, int(lengths.sum())))
    return np.concatenate([np.zeros((len(lists), 1)), np.cumsum(sizes, axis=1)], axis=1)


def _fill(zh: list[list[int]], en: list[list[int]]) -> list[list[tuple[int, int, int, int]] | None]:
    """The cheapest groups of several pieces, whose tables are filled row by row together. A row needs the four before it
    only; what stands beyond a piece's own sentences isn't read for it."""
    n, m, b = np.array([len(x) for x in zh]), np.array([len(x) for x in en]), np.arange(len(zh))
    zp, ep = _padded(zh, int(n.max())), _padded(en, int(m.max()))
    z_all, e_all = zp[b, n][:, None], ep[b, m][:, None]
    overall = np.log(z_all / e_all)
    width = ep.shape[1]
    taken = [ep[:, kj:] - ep[:, :-kj] for kj in range(1, min(MAX_GROUP, width - 1) + 1)]
    first = np.full((len(zh), width), np.inf)
    first[:, 0] = 0.0
    rows = [first]
    choice = np.zeros((len(zh), zp.shape[1], width), np.int8)
    for i in range(1, zp.shape[1]):
        best = np.full((len(zh), width), np.inf)
        drift = DRIFT_WEIGHT * np.abs(zp[:, i : i + 1] / z_all - ep / e_all)
        for ki in range(1, min(MAX_GROUP, i) + 1):
            before, own = rows[-ki], zp[:, i : i + 1] - zp[:, i - ki : i - ki + 1]
            for kj, other in enumerate(taken, 1):
                # Both sides leave the start together: column 0 is finite in row 0 alone.
                cost = own / other
                np.log(cost, out=cost)
                cost -= overall
                np.abs(cost, out=cost)
                cost += before[:, : width - kj]
                cost += drift[:, kj:]
                cost += MERGE_PENALTY * (ki + kj - 2)
                better = cost < best[:, kj:]
                np.copyto(best[:, kj:], cost, where=better)
                np.copyto(choice[:, i, kj:], np.int8(MAX_GROUP * (ki - 1) + kj), where=better)
        rows = [*rows[-MAX_GROUP + 1 :], best]
    i, j, out = n.copy(), m.copy(), [[] for _ in zh]
    lost = np.zeros(len(zh), bool)
    while (going := np.flatnonzero((i + j > 0) & ~lost)).size:
        step = choice[going, i[going], j[going]].astype(np.int64)
        lost[going[step == 0]] = True
        going, step = going[step > 0], step[step > 0]
        ki, kj = (step - 1) // MAX_GROUP + 1, (step - 1) % MAX_GROUP + 1
        for p, *group in zip(going.tolist(), (i[going] - ki).tolist(), i[going].tolist(), (j[going] - kj).tolist(), j[going].tolist(), strict=True):
            out[p].append(tuple(group))
        i[going] -= ki
        j[going] -= kj
    return [None if gone else groups[::-1] for gone, groups in zip(lost, out, strict=True)]


def balanced(zh: list[list[int]], en: list[list[int]]) -> list[list[tuple[int, int, int, int]] | None]:
    """For each piece (sizes of both sides' sentences) the groups (zh from, zh to, en from, en to) of the cheapest monotone
    alignment, or None. A group costs the distance of its length ratio from the whole text's, the drift of its end, and a
    penalty for each further sentence; ties go to the smallest group. Pieces of like sizes share padded tables, those of the same
    sizes one result."""
    sizes = list(zip(map(tuple, zh), map(tuple, en), strict=True))
    first = {own: p for p, own in reversed(list(enumerate(sizes)))}
    out: list = [None] * len(zh)
    # Beyond the largest group on either side there is no alignment.
    order = sorted((p for p in first.values() if zh[p] and en[p] and max(len(zh[p]), len(en[p])) <= MAX_GROUP * min(len(zh[p]), len(en[p]))), key=lambda p: (len(zh[p]), len(en[p])))
    start = 0
    while start < len(order):
        stop, rows, width = start, 0, 0
        while stop < len(order):
            rows, width = max(rows, len(zh[order[stop]]) + 1), max(width, len(en[order[stop]]) + 1)
            if stop > start and (stop - start + 1) * rows * width > CELLS:
                break
            stop += 1
        part = order[start:stop]
        for p, groups in zip(part, _fill([zh[p] for p in part], [en[p] for p in part]), strict=True):
            out[p] = groups
        start = stop
    return [out[first[own]] for own in sizes]


def solvable(n_zh: Column, n_en: Column) -> Column:
    """Whether groups of the largest size can cover both sides."""
    return (F.greatest(n_zh, n_en) <= MAX_GROUP * F.least(n_zh, n_en)) & (F.least(n_zh, n_en) > 0)


GROUPS = "array<struct<zf int, zt int, ef int, et int>>"


def align(pieces: DataFrame, keys: list[str], zh: str = "zh", en: str = "en") -> DataFrame:
    """Pairs of every piece (``zh`` and ``en``: arrays of sentences): ``keys``, ``seq``, ``zh_from``, ``zh_to``,
    ``en_from``, ``en_to``, ``zh``, ``en``, ``how`` (direct, merged, whole) and ``confidence``. A piece that can't be
    balanced is one pair of all its text; a piece with one empty side gives no pairs (:func:`dropped` has its text)."""

    solid = solid_sides(pieces, zh, en)
    return pairs_of(solid.select(*keys, zh, en, balanced_groups(zh, en).alias("_g")), keys, zh, en)


def balanced_groups(zh: str, en: str) -> Column:
    """The groups of two lists of sentences; none if they can't be balanced."""

    @F.arrow_udf(GROUPS)
    def groups(a: pa.Array, b: pa.Array) -> pa.Array:
        found = balanced(a.to_pylist(), b.to_pylist())
        offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in found])]).astype(np.int32)
        places = np.array([g for x in found for g in x or ()], np.int32).reshape(-1, 4)
        every = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in places.T], ["zf", "zt", "ef", "et"])
        return pa.ListArray.from_arrays(pa.array(offsets), every)

    return groups(F.transform(zh, F.length), F.transform(en, F.length))


def solid_sides(pieces: DataFrame, zh: str, en: str) -> DataFrame:
    """Pieces with sentences on both sides, blank ones left out."""
    solid = pieces.withColumns({c: F.filter(F.transform(c, X.strip), lambda s: s != "") for c in (zh, en)})
    return solid.where((F.size(zh) > 0) & (F.size(en) > 0))


def _ratio(n_zh: Column, n_en: Column) -> Column:
    return F.when((n_zh > 0) & (n_en > 0), n_en / n_zh).otherwise(0.0)


def pairs_of(sized: DataFrame, keys: list[str], zh: str, en: str, ratio: str | None = None) -> DataFrame:
    """Pairs of pieces' groups (``_g``); a piece without groups is one pair of all its text. ``ratio``: the name of a column for
    what :func:`flag` asks of the piece, the length of all its English to all its Chinese text."""
    whole = F.array(F.struct(F.lit(0).alias("zf"), F.size(zh).alias("zt"), F.lit(0).alias("ef"), F.size(en).alias("et")))
    sized = sized.withColumn("_whole", F.size("_g") == 0).withColumn("_g", F.when(F.col("_whole"), whole).otherwise(F.col("_g")))
    text = lambda c, f, t, by: F.call_function("array_join", F.slice(c, f + 1, t - f), by)
    joined = F.when(F.col("_whole"), " ").otherwise("")
    # Texts are made before the pairs part: else each takes the whole piece's sentences with it.
    made = F.transform("_g", lambda g: F.struct(g["zf"].alias("zf"), g["zt"].alias("zt"), g["ef"].alias("ef"), g["et"].alias("et"), text(zh, g["zf"], g["zt"], joined).alias("zh"), text(en, g["ef"], g["et"], F.lit(" ")).alias("en")))
    sized = sized.withColumn("_g", made)
    if ratio:
        total = lambda side: F.aggregate(F.transform(F.col(f"_g.{side}"), F.length), F.lit(0).cast("long"), lambda a, n: a + n)
        sized, keys = sized.withColumn(ratio, _ratio(total("zh"), total("en"))), [*keys, ratio]
    pairs = sized.select(*keys, "_whole", F.posexplode("_g").alias("seq", "g"))
    extra = (F.col("g.zt") - F.col("g.zf") - 1) + (F.col("g.et") - F.col("g.ef") - 1)
    # Confidence is 1 less 0.12 for each further sentence; as whole hundredths it needs no rounding.
    confidence = F.when(F.col("_whole"), 0.2).otherwise((100 - 12 * extra) / 100)
    return pairs.select(
        *keys, "seq", F.col("g.zf").alias("zh_from"), F.col("g.zt").alias("zh_to"), F.col("g.ef").alias("en_from"), F.col("g.et").alias("en_to"),
        F.col("g.zh").alias("zh"), F.col("g.en").alias("en"),
        F.when(F.col("_whole"), "whole").when(extra > 0, "merged").otherwise("direct").alias("how"), confidence.alias("confidence"),
    )


def dropped(pieces: DataFrame, keys: list[str], zh: str = "zh", en: str = "en") -> DataFrame:
    """Sentences that no pair holds: all of a piece with one empty side."""
    count = lambda c: F.size(F.filter(c, lambda s: ~X.is_blank(s)))
    sides = pieces.select(*keys, count(zh).alias("n_zh"), count(en).alias("n_en"))
    return sides.where("(n_zh = 0) <> (n_en = 0)").select(*keys, F.col("n_zh").alias("dropped_zh"), F.col("n_en").alias("dropped_en"))


def flag(pairs: DataFrame, keys: list[str], balanced: Column | None = None, ratio: str | None = None) -> DataFrame:
    """``pairs`` with ``needs_review``, ``flagged_by`` and lowered ``confidence``: empty sides, and lengths off twice the
    piece's ratio after its sentence counts; low confidence by merging comes last, for pairs by balanced lengths only
    (``balanced``; None: all are). ``ratio``: a column that has the piece's ratio already; it is dropped."""
    by = Window.partitionBy(*keys)
    measured = pairs.withColumnRenamed(ratio, "_ratio") if ratio else pairs.withColumn("_ratio", _ratio(F.sum(F.length("zh")).over(by), F.sum(F.length("en")).over(by)))
    # Counted once a pair, as several columns ask for it.
    measured = measured.withColumn("_base", X.once(F.col("_ratio") * (X.count_sentences(F.col("en")) / X.count_sentences(F.col("zh")))))
    base, own = F.col("_base"), F.length("en") / F.length("zh")
    empty = (F.col("zh") == "") | (F.col("en") == "")
    off = ~empty & (F.col("_ratio") > 0) & ((own < base / LENGTH_TOLERANCE) | (own > base * LENGTH_TOLERANCE))
    flagged = measured.withColumn("flagged_by", F.when(empty, "empty").when(off, "length_ratio"))
    flagged = flagged.withColumn("confidence", F.when(empty, F.least("confidence", F.lit(0.3))).when(off, F.least("confidence", F.lit(0.4))).otherwise(F.col("confidence")))
    return flagged.withColumn("flagged_by", F.coalesce("flagged_by", F.when((F.lit(True) if balanced is None else balanced) & (F.col("confidence") < LOW_CONFIDENCE), "merge"))).withColumn("needs_review", F.col("flagged_by").isNotNull()).drop("_ratio", "_base")


def coverage(pairs: Column, dropped_zh: Column) -> Column:
    return F.when(pairs + dropped_zh == 0, 0.0).otherwise(pairs / (pairs + dropped_zh))


def chunk_count(n_zh: Column, n_en: Column, size: int = CHUNK) -> Column:
    need = F.greatest(F.ceil(n_zh / size), F.ceil(n_en / size))
    return F.when((n_zh == 0) | (n_en == 0), 1).otherwise(F.greatest(F.lit(1), F.least(need, n_zh, n_en))).cast("int")


def even_chunks(items: Column, k: Column) -> Column:
    """array<struct<chunk, offset, take>>: ``items`` things in ``k`` runs whose sizes differ by one at most, larger first."""
    base, more = F.floor(items / k).cast("int"), (items % k).cast("int")
    return F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(i.alias("chunk"), (i * base + F.least(i, more)).cast("int").alias("offset"), (base + (i < more).cast("int")).alias("take")))


def prompt(zh: Column, en: Column, block: Column) -> Column:
    """The numbered sentence lists that a model is asked to map."""
    listed = lambda c: F.array_join(F.transform(c, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    count = lambda c: F.size(c).cast("string")
    return F.concat(
        F.lit("块 "), block.cast("string"), F.lit("\n\n甲方（"), count(zh), F.lit("）\n"), listed(zh), F.lit("\n\n乙方（"), count(en), F.lit("）\n"), listed(en),
        F.lit('\n\n给出 JSON 数组，每项 {"zh": [...], "en": [...]}，甲方编号全部用到一次。'),
    )


def estimated_tokens(pieces: DataFrame, keys: list[str], system: str = "", zh: str = "zh", en: str = "en", size: int = CHUNK) -> DataFrame:
    """Prompt and completion tokens of mapping every piece by a model, chunk by chunk; no model is called."""
    k = chunk_count(F.size(zh), F.size(en), size)
    parts = pieces.where((F.size(zh) > 0) & (F.size(en) > 0)).withColumn("_c", F.arrays_zip(even_chunks(F.size(zh), k).alias("z"), even_chunks(F.size(en), k).alias("e")))
    take = lambda c, p: F.slice(c, p["offset"] + 1, p["take"])
    asked = F.transform("_c", lambda c: X.estimate_tokens(F.lit(system)) + X.estimate_tokens(prompt(take(F.col(zh), c["z"]), take(F.col(en), c["e"]), c["z"]["chunk"] + 1)))
    told = F.transform("_c", lambda c: F.greatest(F.lit(1), (c["z"]["take"] + c["e"]["take"]) * 8).cast("long"))
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    return parts.select(*keys, total(asked).alias("prompt_tokens"), total(told).alias("completion_tokens"))


def boundaries(pairs: DataFrame, keys: list[str], zh: str = "zh", seq: str = "seq") -> DataFrame:
    """The places between sentences where an alignment cuts, as running counts of Chinese sentences."""
    by = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return pairs.select(*keys, F.sum(X.count_sentences(F.col(zh))).over(by).alias("cut")).distinct()


def agreement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """F1 of the cuts of two alignments for each piece of either."""
    both = a.select(*keys, "cut", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select(*keys, "cut", F.lit(0).alias("a"), F.lit(1).alias("b")))
    met = both.groupBy(*keys, "cut").agg(F.max("a").alias("a"), F.max("b").alias("b")).groupBy(*keys).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("hit"))
    return met.select(*keys, (2 * F.col("hit") / (F.col("a") + F.col("b"))).alias("agreement"))


def agreement_confidence(value: Column, floor: float = AGREEMENT_FLOOR) -> Column:
    line = LOW_CONFIDENCE + (1 - LOW_CONFIDENCE) * (value - floor) / max(1e-9, 1 - floor)
    return F.when(value >= 0.999, 1.0).when(value <= floor, LOW_CONFIDENCE - 0.05).otherwise(line)

