"""Token ids in seekable files: independent zstandard frames, a trailing seek table, checksums per frame.

File: zstandard frames one after another, each with the ids (little-endian uint32) of a run of documents;
then one skippable frame (magic 0x184D2A50) with the document index, itself compressed; then the seek table of
the public seekable format: a skippable frame (0x184D2A5E) with compressed size, size and checksum (the low 32
bits of XXH64) of each frame, and a footer (number of frames, flags, 0x8F92EAB1). A reader takes the footer,
the table and the index, then only the frames that hold the documents asked for.

Documents are sorted by range over all files, so the ids before a document are those of the files before, of
which the driver adds up one number a file. Task attempts write files of their own; only those that the
finished tasks name are read, so a lost executor leaves at most an unread file.

Defined cases: a null or empty text has the end id alone; a null doc_id comes before all others; repeated rows
are documents of their own, ordered by text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path
from .encode import encoder as encoder_of
from .kernel import slices

FRAME_BYTES = 1 << 18
#: Bytes of ids, and documents, after which a partition goes on in a new file: its index is held in memory.
FILE_BYTES, FILE_DOCS = 1 << 28, 1 << 18
INDEX_MAGIC, TABLE_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


class Writer:
    def __init__(self, sink):
        self.sink, self.at = sink, 0
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []  # frame, first byte in it, bytes
        self.ids: list[int | None] = []
        self.pending: list[bytes] = []
        self.size = 0
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > FRAME_BYTES:
            self.flush()
        self.docs.append((len(self.table), self.size, len(ids)))
        self.ids.append(doc_id)
        self.pending.append(ids)
        self.size += len(ids)

    def flush(self) -> None:
        data = b"".join(self.pending)
        frame = self.press.compress(data)
        self.sink.write(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def close(self) -> None:
        if self.pending:
            self.flush()
        present = np.array([x is not None for x in self.ids], np.uint8)
        ids = np.array([x or 0 for x in self.ids], "<i8")
        places = np.array(self.docs, "<i8").reshape(-1, 3)
        index = self.press.compress(present.tobytes() + ids.tobytes() + places.tobytes())
        self.sink.write(struct.pack("<IIQ", INDEX_MAGIC, len(index) + 8, len(self.ids)) + index)
        body = b"".join(struct.pack("<III", *x) for x in self.table)
        self.sink.write(struct.pack("<II", TABLE_MAGIC, len(body) + 9) + body + struct.pack("<IBI", len(self.table), 0x80, FOOT_MAGIC))


class Reader:
    def __init__(self, source):
        self.source, size = source, source.size()
        self.frames_read = 0
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOT_MAGIC or not flags & 0x80:
            raise ValueError("no seek table at the end of the file")
        body = self._at(size - 9 - 12 * frames, 12 * frames)
        self.table = [struct.unpack_from("<III", body, 12 * i) for i in range(frames)]
        self.starts = np.concatenate([[0], np.cumsum([x[0] for x in self.table])]).astype(np.int64)
        head, length, n = struct.unpack("<IIQ", self._at(int(self.starts[-1]), 16))
        if head != INDEX_MAGIC:
            raise ValueError("no document index where the frames end")
        self.press = zstandard.ZstdDecompressor()
        index = self.press.decompress(self._at(int(self.starts[-1]) + 16, length - 8), max_output_size=33 * n or 1)
        present, ids = np.frombuffer(index, np.uint8, n), np.frombuffer(index, "<i8", n, n)
        self.ids = [int(i) if p else None for p, i in zip(present, ids, strict=True)]
        self.places = np.frombuffer(index, "<i8", 3 * n, 9 * n).reshape(-1, 3)
        self._held: tuple[int, bytes] = (-1, b"")

    def _at(self, start: int, length: int) -> bytes:
        self.source.seek(start)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            packed, size, check = self.table[k]
            data = self.press.decompress(self._at(int(self.starts[k]), packed), max_output_size=size or 1)
            if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._held = (k, data)
        return self._held[1]

    def document(self, row: int) -> bytes:
        k, start, length = map(int, self.places[row])
        return self.frame(k)[start : start + length]


def _open(path: str):
    uri = path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace("file:/", "file:///", 1)
    return pafs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, leading: bool = False) -> list[tuple[str, int, int]]:
    """Writes the files; returns (path, documents, ids) of each file in order: a row a file."""

    schema = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = encoder_of(tokenizer, leading), struct.pack("<I", end_id)
        part, number, writer, path, size = TaskContext.get().partitionId(), 0, None, "", 0

        def closed() -> pa.RecordBatch:
            writer.close()
            writer.sink.close()
            return pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "docs": [len(writer.ids)], "ids": [size // 4]}, schema)

        for part_of in (p for batch in batches for p in slices(batch, 64)):
            for doc_id, text in zip(part_of.column(0).to_pylist(), part_of.column(1).to_pylist(), strict=True):
                if writer is None:
                    path = f"{folder}/part-{part:06d}-{number:06d}-{uuid.uuid4().hex}.zst"
                    fs, inner = _open(path)
                    fs.create_dir(inner.rpartition("/")[0], recursive=True)
                    writer, size = Writer(fs.open_output_stream(inner, compression=None)), 0
                ids = encoder.encode(text) + end
                size += len(ids)
                writer.add(doc_id, ids)
                if size >= FILE_BYTES or len(writer.ids) >= FILE_DOCS:
                    yield closed()
                    writer, number = None, number + 1
        if writer is not None:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, F.asc_nulls_first("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
            .mapInArrow(save, "part int, number int, path string, docs long, ids long").collect())
    return [(r.path, r.docs, r.ids) for r in sorted(rows, key=lambda r: (r.part, r.number))]


def read(spark, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    base, rows = 0, []
    for path, _, ids in files:
        rows.append((path, base))
        base += ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, inner = _open(path)
                with fs.open_input_file(inner) as source:
                    r, out = Reader(source), []
                    for i, doc_id in enumerate(r.ids):
                        ids = r.document(i)
                        out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                        start += len(ids) // 4
                for i in range(0, len(out), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000], strict=True), schema.types, strict=True)], schema=schema)

    todo = spark.createDataFrame(rows, "path string, start long")
    return todo.repartition(max(1, len(rows))).mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def fetch(files: list[str], doc_ids: set[int]) -> dict[int, np.ndarray]:
    """The ids of the documents asked for; only the frames that hold them are decompressed."""
    out = {}
    for path in files:
        fs, inner = _open(path)
        with fs.open_input_file(inner) as source:
            r = Reader(source)
            out |= {d: np.frombuffer(r.document(i), "<u4") for i, d in enumerate(r.ids) if d in doc_ids}
    return out


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    spark = docs.sparkSession
    return read(spark, write(docs, new_path(spark, "tokens"), tokenizer, end_id))
