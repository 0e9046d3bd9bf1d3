"""Reading documents and files: text files, page text, content addresses, uploads in chunks."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators.cleaning import drop_junk_groups, kept_lines, page_groups

# File types with a reader; look-ahead of lines, length of the key by which page lines are found again, and
# the most characters that one paragraph takes.
READERS = {".txt": "text", ".md": "text", ".pdf": "pages"}
LOOK_AHEAD, KEY_LENGTH, PARAGRAPH_LIMIT = 12, 24, 200_000


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def reader_of(path: Column) -> Column:
    """Which reader takes a file; ``no_parser`` for other types."""
    table = F.create_map(*(F.lit(x) for kv in READERS.items() for x in kv))
    return F.coalesce(table[extension(path)], F.lit("no_parser"))


@F.pandas_udf(T.StringType())
def _gb18030(data: pd.Series) -> pd.Series:
    def decode(x):
        try:
            return None if x is None else bytes(x).decode("gb18030")
        except UnicodeDecodeError:
            return None

    return data.map(decode)


def decoded(content: Column) -> Column:
    """Bytes as text: UTF-8 with or without a mark, else GB18030, else null; line ends become line feeds."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    text = F.coalesce(F.regexp_replace(utf8, r"^\x{feff}", ""), _gb18030(F.when(utf8.isNull(), content)))
    return F.regexp_replace(text, r"\r\n?", "\n")


def text_blocks(files: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """Paragraphs of text files: ``block_no``, ``page`` (always 0), ``text`` and ``zh_ratio``."""
    rows = files.select(*keys, F.posexplode(X.paragraphs(decoded(F.col(content)))).alias("block_no", "text"))
    return rows.select(*keys, "block_no", F.lit(0).alias("page"), "text", X.clamped_ratio(F.col("text")).alias("zh_ratio"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all text files below a path, by Spark's reader of binary files; ``path`` and ``sha256`` of each."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kept = files.where(reader_of(F.col("path")) == "text").select("path", F.sha2("content", 256).alias("sha256"), "content")
    return text_blocks(kept, ["path", "sha256"])


_SOLID = re.compile(r"\s+")


def plain_paragraphs(groups: list[list[str]], plain: str) -> list[str]:
    """Paragraph borders of the layout text with the characters of the plain text. Lines are found by the beginning of what
    is left of them without white space, a few lines ahead of the last paragraph's end; the paragraph ends where as many
    characters have passed as its layout lines hold. Both are binary searches: in the places of each beginning, and in the
    running lengths. A paragraph that isn't found keeps its layout lines."""
    solid = lambda s: _SOLID.sub("", s)
    lines = plain.split("\n")
    keys = [solid(x) for x in lines]
    passed = list(accumulate(map(len, keys), initial=0))
    places: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(keys):
        places[x[:KEY_LENGTH]].append(i)
    end, out = 0, []
    for group in groups:
        own = list(map(solid, group))
        known = places.get(own[0][:KEY_LENGTH], ()) if own[0] else ()
        at = bisect_left(known, end)
        if at == len(known) or known[at] >= end + LOOK_AHEAD:
            out.append("\n".join(group))
            continue
        start = known[at]
        goal = passed[start] + min(sum(map(len, own)), PARAGRAPH_LIMIT)
        end = min(bisect_left(passed, goal), len(lines))
        out.append("\n".join(x for x, key in zip(lines[start:end], keys[start:end], strict=True) if key))
    return out


def page_blocks(pages: DataFrame, keys: list[str], page: str = "page", layout: str = "layout", plain: str = "plain") -> DataFrame:
    """Blocks of pages given as layout text and plain text: ``block_no`` over the document, ``page``, ``text``, ``zh_ratio``.
    The texts come from a page reader of one's own, as none is installed here."""

    own = pages.select(*keys, F.col(page).alias("page")).schema
    schema = T.StructType([*own.fields, T.StructField("_n", T.IntegerType()), T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [plain_paragraphs(g, t or "") for g, t in zip(batch.column("_g").to_pylist(), batch.column("_t").to_pylist(), strict=True)]
            at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
            texts = [pa.array([n for x in found for n in range(len(x))], pa.int32()), pa.array([t for x in found for t in x], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in own.names), *texts], names=schema.names)

    grouped = pages.select(*keys, F.col(page).alias("page"), X.once(page_groups(F.col(layout))).alias("_groups"), F.col(plain).alias("_t"))
    rows = grouped.select(*keys, "page", drop_junk_groups(F.col("_groups")).alias("_g"), "_t").mapInArrow(run, schema).withColumn("_lines", F.split("_text", "\n", -1))
    kept = kept_lines(F.col("_lines"))
    rows = rows.withColumn("text", X.once(X.strip(F.array_join(kept, "\n")))).where("text <> ''")
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("page", "_n")) - 1
    return rows.select(*keys, number.alias("block_no"), "page", "text", X.clamped_ratio(F.col("text")).alias("zh_ratio"))


def pages_json(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``pages``: JSON of a document's blocks by page, pages and blocks in order, ratios to four digits."""
    block = F.struct("block_no", F.struct(F.col("block_no").alias("order"), F.lit("body").alias("kind"), "text", F.bround("zh_ratio", 4).alias("zh_ratio")).alias("b"))
    by_page = blocks.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(block)).alias("_b"))
    return by_page.groupBy(*keys).agg(F.to_json(F.array_sort(F.collect_list(F.struct("page", F.col("_b.b").alias("blocks"))))).alias("pages"))


def raw_text(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """The blocks of a document joined by line feeds."""
    return blocks.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("block_no", "text")))["text"], "\n").alias("text"))


def content_path(sha256: Column, ext: Column) -> Column:
    """``aa/bb/<sha256><ext>``; no or long extensions become ``.bin``."""
    safe = F.when((F.length(ext) > 0) & (F.length(ext) <= 12), F.lower(ext)).otherwise(".bin")
    return F.concat(F.substring(sha256, 1, 2), F.lit("/"), F.substring(sha256, 3, 2), F.lit("/"), sha256, safe)


def first_files(files: DataFrame, project: str, order: list[str], sha256: str = "sha256") -> DataFrame:
    """One file of equal content in each project: the first. Rows are reduced map-side, not sorted."""
    rest = [c for c in files.columns if c not in (project, sha256)]
    first = files.groupBy(project, sha256).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_f"), F.count("*").alias("copies"))
    return first.select(project, sha256, *(F.col(f"_f.{c}").alias(c) for c in rest), "copies")


def live_files(files: DataFrame, project: str, order: list[str]) -> DataFrame:
    """Files that aren't deleted, with their ``place`` in their project's list."""
    by = Window.partitionBy(project).orderBy(*order)
    return files.where("deleted_at is null").withColumn("place", (F.row_number().over(by) - 1).cast("int"))


def chunk_total(size: Column, chunk: int) -> Column:
    return F.ceil(size / chunk).cast("int")


def missing_chunks(sessions: DataFrame, received: DataFrame, chunk: int, session: str = "session_id") -> DataFrame:
    """``missing``: numbers of a session's chunks that haven't come, in order."""
    have = received.groupBy(session).agg(F.collect_set("index").alias("_have"))
    joined = sessions.join(have, session, "left").withColumn("total", chunk_total(F.col("size"), chunk))
    every = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.col("total") - 1)).otherwise(F.array().cast("array<int>"))
    return joined.withColumn("missing", F.array_sort(F.array_except(every, F.coalesce("_have", F.array().cast("array<int>"))))).drop("_have")


def completed(sessions: DataFrame, received: DataFrame, chunk: int, session: str = "session_id") -> DataFrame:
    """``refusal`` of each session (chunks, size, checksum; null: complete). Chunks are sorted by their place and hashed one
    after the other, so a task holds one chunk at a time, not an upload."""
    schema = received.select(session, F.lit("").alias("_digest"), F.lit(0).cast("long").alias("_size")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, size = None, None, 0
        for batch in batches:
            for key, data in zip(batch.column(session), batch.column("data"), strict=True):
                if digest is None or key != now:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now.as_py()], now.type), pa.array([digest.hexdigest()]), pa.array([size])], names=schema.names)
                    now, digest, size = key, hashlib.sha256(), 0
                digest.update(data.as_buffer() if data.is_valid else b"")
                size += len(data.as_buffer()) if data.is_valid else 0
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now.as_py()], now.type), pa.array([digest.hexdigest()]), pa.array([size])], names=schema.names)

    # A chunk that came twice counts once.
    once = received.select(session, "index", "data").dropDuplicates([session, "index"])
    found = once.repartition(session).sortWithinPartitions(session, "index").select(session, "data").mapInArrow(run, schema)
    joined = missing_chunks(sessions, received, chunk, session).join(found, session, "left")
    empty = hashlib.sha256().hexdigest()
    wrong = F.coalesce("_digest", F.lit(empty)) != F.col("sha256")
    refusal = F.when(F.size("missing") > 0, "chunks").when(F.coalesce("_size", F.lit(0)) != F.col("size"), "size").when(wrong, "checksum")
    return joined.withColumn("refusal", refusal).drop("_digest", "_size")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length`` and ``modificationTime`` of all files below a path but those without a byte, which Spark's reader
    leaves out; their content isn't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def expired(files: DataFrame, now: str, days: int, at: str = "modificationTime") -> DataFrame:
    """Files of a bin that are older than the days they are kept."""
    return files.where(F.col(at) < F.lit(now).cast("timestamp") - F.expr(f"interval {days} days"))


def purge(spark: SparkSession, path: str, now: str, days: int) -> int:
    """Delete the files of a bin that are older than ``days`` before ``now`` (UTC), empty ones too; how many went. Names come from the
    file system one after the other."""
    limit = (datetime.fromisoformat(now).replace(tzinfo=UTC) - timedelta(days=days)).timestamp() * 1000
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files, gone = store.listFiles(root, True), 0
    while files.hasNext():
        f = files.next()
        if f.getModificationTime() < limit:
            gone += bool(store.delete(f.getPath(), False))
    return gone


def usage_bytes(files: DataFrame, length: str = "length") -> DataFrame:
    return files.agg(F.coalesce(F.sum(length), F.lit(0)).alias("bytes"))


#: From a file's bytes to its (page, text) blocks.
Parser = Callable[[bytes], list[tuple[int, str]]]


def read_documents(spark: SparkSession, path: str, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """``path``, ``block_no``, ``page``, ``text``, ``zh_ratio`` and ``error`` of all files below a path. Text files are read by columns; ``parsers`` are readers of other
    types by their lower-cased extension, run on executors. A file without a reader has one row with ``no_parser``, one whose
    reader fails or finds nothing has ``failed: ...`` or ``empty``; neither stops the others. Files without a byte have no row."""
    every = listed(spark, path).select("path", extension(F.col("path")).alias("ext"))
    load = lambda exts: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(extension(F.col("path")).isin(*exts)).select("path", extension(F.col("path")).alias("ext"), "content")
    own = dict(parsers or {})
    texts = [x for x, reader in READERS.items() if reader == "text" and x not in own]
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("block_no", T.IntegerType()), T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, ext, data in zip(*(batch.column(c).to_pylist() for c in ("path", "ext", "content")), strict=True):
                try:
                    found = own[ext](data)
                except Exception as e:  # a reader's own failure is the file's result
                    rows.append((name, None, None, None, f"failed: {e}"))
                    continue
                rows += [(name, i, page, text, None) for i, (page, text) in enumerate(found)] or [(name, None, None, None, "empty")]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=pa.schema([("path", pa.string()), ("block_no", pa.int32()), ("page", pa.int32()), ("text", pa.string()), ("error", pa.string())]))

    columns = [*schema.names[:4], F.when(F.col("text").isNotNull(), X.clamped_ratio(F.col("text"))).alias("zh_ratio"), "error"]
    out = every.where(~F.col("ext").isin(*texts, *own)).select("path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:4]), F.lit("no_parser").alias("error"))
    if texts:
        files = load(texts)
        blocks = text_blocks(files, ["path"]).select(*schema.names[:4], F.lit(None).cast("string").alias("error"))
        whole = files.select("path", decoded(F.col("content")).alias("t"))
        bare = whole.where(F.coalesce(F.size(X.paragraphs(F.col("t"))), F.lit(0)) <= 0).select("path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:4]), F.when(F.col("t").isNull(), "failed: encoding").otherwise("empty").alias("error"))
        out = out.unionByName(blocks).unionByName(bare)
    if own:
        out = out.unionByName(load(list(own)).mapInArrow(run, schema))
    return out.select(*columns)
