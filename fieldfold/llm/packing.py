"""Sequence packing along a space-filling curve.

A document's words are hashed into a sparse vector and projected to a few dimensions; the Hilbert index of
that point is the sort key, so documents of like words meet. Documents are dealt out by ranges of the key and sorted; along each range
the ids of all documents are laid end to end and cut at the sequence length, so sequences are full. What is
left at the end of a range is cut into powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as documents of their own,
next to each other; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .encode import encoder as encoder_of

SEQUENCE = 2048
DIMENSIONS, BITS = 4, 8
#: Documents sampled for the bounds of the ranges, about.
BOUNDS = 20_000
#: Buckets that words are hashed to before projection.
BUCKETS = 1024


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points (rows), by Skilling's transposition (AIP Conf. Proc. 707, 2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] ^= np.where(high, p, swap)
            if i:
                x[i] ^= np.where(high, 0, swap)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def keys(texts: pa.Array, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """The Hilbert key of each text."""
    axes = np.random.default_rng(11).standard_normal((BUCKETS, dimensions))
    out = np.zeros(len(texts), np.int64)
    for row, end, data, offsets in kernel.pieces(texts):
        data, starts, ends, at = kernel.word_bounds(data, offsets, "space")
        bucket = (kernel.word_bags(data, starts, ends) & np.uint64(BUCKETS - 1)).astype(np.int64)
        n = np.diff(at)
        owner = np.repeat(np.arange(end - row), n)
        total = np.stack([np.bincount(owner, axes[bucket, j], end - row) for j in range(dimensions)], 1)
        # a mean of n random axes spreads as 1/sqrt(n), texts of one language are far apart: a logistic scale holds both
        z = total / np.sqrt(np.maximum(n, 1))[:, None] / 4
        out[row:end] = hilbert((1 / (1 + np.exp(-np.clip(z, -30, 30))) * ((1 << bits) - 1)).astype(np.int64), bits)
    return out


def tail_cuts(length: int, sequence: int = SEQUENCE) -> list[int]:
    """Lengths of the last sequences: powers of two that add up to what is left."""
    return [1 << b for b in range(sequence.bit_length() - 1, -1, -1) if length >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, hilbert_key."""

    def place(b: pa.RecordBatch) -> np.ndarray:
        return keys(b.column(1)) << 31 | b.column(2).to_numpy()

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(place(b)), pc.cast(pc.binary_length(pc.fill_null(b.column(1), "")), pa.int64())], ["place", "size"])

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = place(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, at, side="right").astype(np.int32)), pa.array(at), *b.columns[:2]], ["part", "key", "doc_id", "text"])

    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "hilbert_key")])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = encoder_of(tokenizer, True), struct.pack("<I", end_id)
        number = TaskContext.get().partitionId() << 40
        done: list[tuple] = []
        open_pieces: list[tuple] = []  # of the sequence being filled, with their ids
        filled = 0

        def close(cuts: list[int]) -> None:
            nonlocal number, open_pieces, filled
            rest = open_pieces
            for room in cuts:
                offset = 0
                while offset < room:
                    doc, start, ids, total, k = rest[0]
                    take = min(len(ids) // 4, room - offset)
                    done.append((doc, start, take, zlib.crc32(ids[: 4 * take]), total, number, offset, k))
                    offset += take
                    rest = rest[1:] if 4 * take == len(ids) else [(doc, start + take, ids[4 * take :], total, k), *rest[1:]]
                number += 1
            open_pieces, filled = [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*done, strict=True)], schema=schema)
            done.clear()
            return out

        for b in batches:
            for part_of in kernel.slices(b):
                for place_of, doc, text in zip(*(c.to_pylist() for c in part_of.columns), strict=True):
                    ids = encoder.encode(text) + end
                    total, at = len(ids) // 4, 0
                    while at < total:
                        take = min(total - at, sequence - filled)
                        open_pieces.append((doc, at, ids[4 * at : 4 * (at + take)], total, place_of >> 31))
                        filled, at = filled + take, at + take
                        if filled == sequence:
                            close([sequence])
                    if len(done) >= 10_000:
                        yield batch()
        close(tail_cuts(filled, sequence))
        if done:
            yield batch()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a hash of the row's number stands below the key, so that equal keys (copies, rows repeated id and all) still spread
    # over ranges and the sample takes its share of them; a task that runs again reads the same rows under the same numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit(0x7FFFFFFF)).alias("tie"))
    every = max(1, docs.count() // BOUNDS)
    # the sample only balances the ranges; all rows are keyed and packed once
    found = rows.where(F.col("tie") % every == 0).limit(4 * BOUNDS).mapInArrow(sampled, "place long, size long").collect()
    found.sort()
    sample, size = (np.array([r[c] for r in found], np.int64) for c in ("place", "size"))
    # ranges of about equal bytes: long texts lie together on the curve
    reached = np.cumsum(size + 64)
    bounds = sample[np.searchsorted(reached, np.arange(1, n) * (reached[-1] / n))] if len(sample) else sample
    placed = rows.mapInArrow(key, "part int, key long, doc_id long, text string").repartitionById(n, "part").drop("part").sortWithinPartitions("key", "doc_id", "text")
    return placed.mapInArrow(lay, ", ".join(f"{c} long" for c in schema.names))
