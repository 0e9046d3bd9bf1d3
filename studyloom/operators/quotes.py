"""Which quotes stand in which sources, as joins on a quote's rarest piece of text.

A quote stands in a source if it does so without white space, or without white space and full-width forms. As each character is
folded by itself, the first implies the second, so texts are compared fully folded. Of every eight neighbouring pieces of eight bytes a text keeps the one with the lowest hash, so a source
keeps every piece that a quote in it keeps. A quote one of whose pieces no source keeps stands nowhere; any other meets
the sources that keep its rarest piece, and is looked for in these. Quotes too short for that are looked for by all
pieces of their own length. Equal quotes are one pattern. Only hashes of eight bytes, patterns and candidates' texts move;
nothing is sent to all executors.

A null or blank quote stands in no source; repeated rows each count; a null source holds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import stored

GRAM, WINDOW = 8, 8
#: Bytes of the shortest quote that has a whole window.
LONG = GRAM + WINDOW - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes (up to 15) from every place on."""
    n = len(data) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _BASE + data[i : i + n].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def kept_grams(text: bytes, size: int) -> np.ndarray:
    """The distinct hashes that a text keeps: all of a short ``size``, or (0) those of windows' lowest."""
    h = gram_hashes(np.frombuffer(text, np.uint8), size or GRAM)
    if not size and len(h):
        if len(h) < WINDOW:
            return h[:0]
        h = np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)
    return np.unique(h)


def _grams(rows: DataFrame, sizes: list[int] | None) -> DataFrame:
    """(id, size, gram) of ``rows`` (id, t): of each of ``sizes``, or of the row's own ``size``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("size").to_pylist() if sizes is None else None
            for i, t in enumerate(batch.column("t").to_pylist()):
                for size in [own[i]] if own else sizes:
                    found = kept_grams(t.encode(), size)
                    if len(found):
                        ids = batch.column("id").take(pa.array(np.full(len(found), i)))
                        yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(found), size, np.int32)), pa.array(found.view(np.int64))], names=["id", "size", "gram"])

    return rows.mapInArrow(run, "id long, size int, gram long")


def standing(sources: DataFrame, quotes: DataFrame, source_id: str, quote_id: str, text: str = "text") -> DataFrame:
    """(source id, quote id) of every quote that stands in a source, once for each pair of rows."""
    folded = lambda df, name: df.select(F.col(name), X.fold_all(F.col(text)).alias("t")).where("t <> ''")
    texts = stored(folded(sources, source_id).withColumn("id", F.monotonically_increasing_id()), "sources")
    asked = stored(folded(quotes, quote_id), "quotes")
    size = F.when(F.octet_length("t") < LONG, F.octet_length("t")).otherwise(0)
    patterns = stored(asked.select("t").distinct().withColumns({"id": F.monotonically_increasing_id(), "size": size}), "patterns")
    sizes = sorted(r[0] for r in patterns.select("size").distinct().collect())  # LONG at most
    on = ["size", "gram"]
    wanted = stored(_grams(patterns.select("id", "size", "t"), None), "pattern-grams")
    held = stored(_grams(texts.select("id", "t"), sizes).join(wanted.select(*on).distinct(), on, "left_semi"), "source-grams")
    counted = wanted.join(held.groupBy(*on).agg(F.count("*").alias("n")), on, "left")
    rarest = counted.groupBy(F.col("id").alias("pattern"), "size").agg(F.min_by("gram", "n").alias("gram"), F.count_if(F.col("n").isNull()).alias("missing")).where("missing = 0")
    met = rarest.join(held, on).select("pattern", "id").join(patterns.select(F.col("id").alias("pattern"), F.col("t").alias("p")), "pattern").select("id", "p")
    hits = texts.join(met, (texts.id == met.id) & F.contains(texts.t, met.p)).select(texts[source_id], "p")
    return hits.join(asked.withColumnRenamed("t", "p"), "p").select(source_id, quote_id)
