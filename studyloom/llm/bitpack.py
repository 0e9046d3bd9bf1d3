"""Token ids in fixed-width bit-packed files.

A file holds documents in ascending id order. Layout, all numbers little-endian:

  magic ``SLTB`` | u8 bits per id | blocks | block table | document table | footer

Blocks are ``block_ids`` ids each (the last one shorter) packed at the least number of bits that holds the vocabulary;
ids lie at bit ``k * bits`` of their block, lowest bit first. The block table has the byte offset of every block, so
any id range is read by seeking to its blocks. The document table has the row's document id, a null mark and the
running number of ids. The 56-byte footer gives the places and sizes of both tables.

Files are written by tasks into the shared folder, each under a name of its own attempt; only files named by a
finished task's row are read, so a task that runs twice leaves nothing wrong. Defined results: null and empty texts
are documents with the end id alone; equal document ids stay neighbours in the order of their text's hash; a null
document id comes first; an empty table makes no files.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, raw_bytes, shared_path, slices, written
from .word_ids import encoder

MAGIC = b"SLTB"
BLOCK_IDS = 1 << 15
#: A file holds the ids of about so many bytes of text, or documents, at most; more files are made of a larger corpus.
FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20
_FOOTER = struct.Struct("<QQQQQQQ")


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Fixed-width packing, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype("<u4")[:, None] >> np.arange(bits, dtype=np.uint32)).astype(np.uint8) & 1
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int, skip: int = 0) -> np.ndarray:
    """``n`` ids of a packed block after the first ``skip``, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n, skip * bits // 8).astype("<u4")
    raw = np.frombuffer(data, np.uint8)[skip * bits // 8 :]
    planes = np.unpackbits(raw, bitorder="little")[skip * bits % 8 :][: n * bits].reshape(n, bits)
    return (planes.astype("<u4") << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype="<u4")


class Writer:
    """Streams ids to one file; memory is a block and the document table."""

    def __init__(self, stream, bits: int, block_ids: int = BLOCK_IDS):
        self.stream, self.bits, self.block_ids = stream, bits, block_ids
        self.place = self.total = self.pending = 0
        self.buffer: list[np.ndarray] = []
        self.blocks: list[int] = []
        self.docs = array("q")
        self._put(MAGIC + bytes([bits]))

    @property
    def n_docs(self) -> int:
        return len(self.docs) // 3

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.place += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.extend((doc_id or 0, doc_id is None, self.total))
        self.total += len(ids)
        self.pending += len(ids)
        self.buffer.append(ids)
        if self.pending >= self.block_ids:
            every = np.concatenate(self.buffer)
            whole = len(every) // self.block_ids * self.block_ids
            for i in range(0, whole, self.block_ids):
                self._block(every[i : i + self.block_ids])
            self.buffer, self.pending = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.blocks.append(self.place)
        self._put(pack(ids, self.bits))

    def close(self) -> None:
        if self.pending:
            self._block(np.concatenate(self.buffer))
        blocks_at = self.place
        self._put(np.array([*self.blocks, blocks_at], "<u8").tobytes())
        docs_at = self.place
        table = np.frombuffer(self.docs, np.int64).astype("<i8").reshape(-1, 3)
        self._put(table.T.copy().tobytes())
        self._put(_FOOTER.pack(blocks_at, len(self.blocks), docs_at, self.n_docs, self.total, self.block_ids, self.bits))


class Reader:
    """Random access to one file: only the tables and the asked blocks are read."""

    def __init__(self, stream):
        self.stream = stream
        end = stream.size() if callable(getattr(stream, "size", None)) else stream.seek(0, 2)
        blocks_at, n_blocks, docs_at, n_docs, self.total, self.block_ids, self.bits = _FOOTER.unpack(self._at(end - _FOOTER.size, _FOOTER.size))
        self.blocks = np.frombuffer(self._at(blocks_at, 8 * (n_blocks + 1)), "<u8")
        table = np.frombuffer(self._at(docs_at, 24 * n_docs), "<i8").reshape(3, n_docs)
        self.doc_ids, self.null, self.starts = table[0], table[1].astype(bool), np.append(table[2], self.total)

    def _at(self, place: int, n: int) -> bytes:
        self.stream.seek(int(place))
        return self.stream.read(int(n))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from ``start`` to ``stop`` of the file."""
        parts = []
        while start < stop:
            k, skip = divmod(start, self.block_ids)
            n = min(stop - start, self.block_ids - skip)
            parts.append(unpack(self._at(self.blocks[k], self.blocks[k + 1] - self.blocks[k]), self.bits, n, skip))
            start += n
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order, block by block."""
        held, at, k = np.zeros(0, "<u4"), 0, 0
        for i in range(len(self.doc_ids)):
            need = int(self.starts[i + 1])
            parts = [held]
            have = at + len(held)
            while have < need:
                n = min(self.block_ids, self.total - k * self.block_ids)
                parts.append(unpack(self._at(self.blocks[k], self.blocks[k + 1] - self.blocks[k]), self.bits, n))
                have += n
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            n = need - at
            yield (None if self.null[i] else int(self.doc_ids[i])), held[:n]
            held, at = held[n:], need


def _open(path: str):
    where, name = fs.FileSystem.from_uri(path)
    return where, name


def write_files(documents: DataFrame, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Tokenise whole texts and write them in ascending id order, a file for each range of ids. Returns the list of
    files (``part``, ``path``, ``n_docs``, ``n_ids``), a row for each file. One range shuffle of the texts, which are smaller in it than
    a written table of packed ids and its shuffle together; there are as many ranges as the bytes of all texts and the
    documents need, and ``partitions`` (or the session's shuffle partitions) at least."""
    spark = documents.sparkSession
    folder = shared_path(spark, "tokens")
    size, docs = documents.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    n = max(partitions or int(spark.conf.get("spark.sql.shuffle.partitions")), (size or 0) // FILE_BYTES + 1, docs // FILE_DOCS + 1)
    # Numbers of rows tell equal rows apart, so that a range never has to hold all of them.
    keyed = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().alias("nth"))
    order = ("doc_id", "h", "nth")
    rows = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, writer, sink, part = encoder(tokenizer), None, None, None
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "text", 2 << 20):
            if writer is None:
                part = batch.column("part")[0].as_py()
                where, name = _open(folder)
                where.create_dir(name, recursive=True)
                name = f"{name}/part-{part:06d}-{uuid.uuid4().hex}.sltb"
                sink = where.open_output_stream(name)
                writer = Writer(sink, bits_for(model.vocab_size), block_ids)
            texts = [(x or b"").decode("utf-8", "replace") for x in raw_bytes(batch.column("text")).to_pylist()]
            for i, raw in zip(batch.column("doc_id").to_pylist(), model.encode(texts), strict=True):
                writer.add(i, np.frombuffer(raw + end, "<u4"))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"part": part, "path": f"{folder}/{name.rsplit('/', 1)[1]}", "n_docs": writer.n_docs, "n_ids": writer.total}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return written(rows.mapInArrow(lean(run), "part int, path string, n_docs long, n_ids long"), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """Every document of the files: ``doc_id``, ``start`` (ids of all documents before it, over all files), ``n_tokens``
    and ``ids_crc32``. The file list is one small row a file; only it is put in one order."""
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("base", F.coalesce(before, F.lit(0)))
    # Each file is read by one task.
    listed = listed.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                where, name = _open(path)
                with where.open_input_file(name) as stream:
                    reader, rows = Reader(stream), []
                    for (i, ids), start in zip(reader.documents(), reader.starts[:-1].tolist(), strict=True):
                        rows.append((i, base + start, len(ids), zlib.crc32(ids.tobytes())))
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return listed.mapInArrow(lean(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
