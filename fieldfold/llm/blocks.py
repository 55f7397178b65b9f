"""A corpus as blocks of symbols in order, and which of their substrings recur.

Documents are sorted by doc_id over all partitions and laid into blocks of about a megabyte; a long text becomes
several segments, which overlap by the longest window less one symbol, so no task ever holds more than a block.
A level of doubling names the candidate positions of every block. Names are dealt by range to buckets and sorted
there, a list a block: a name that stands twice in a block is one entry, so what is hot is aggregated before it is
shuffled, and buckets are even as names are hashes. A block gets back one bit an entry. At the inner levels it says
whether the name stands elsewhere too; what stands once goes, and blocks shrink to the runs of symbols that can still
hold a repeated window. At the last level it says whether an earlier block has the name. Positions are never shuffled.

Names of the inner levels have up to 43 bits, of which a list holds the 32 below its bucket's: chance can only leave a
candidate too many there (one in two thousand while a bucket has two million names; beyond some 10^12 symbols, blocks
should be smaller, which leaves more bits for the name). At the last level a second name of 64 bits stands beside it.

A level goes through its names in a fixed number of classes (by first, inner and last level), at every size, so that only
a class's part is on disk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import drop, materialise, text_of

U = np.uint64
#: Bytes of a block, about; symbols of a segment at most.
BLOCK, SEGMENT = 1 << 20, {"bytes": 1 << 20, "space": 1 << 17}
#: Bits of a place in a block, which stand below the name in what is sorted.
PLACE = 21
#: There are about as many buckets as the square root of so many parts of the symbols: lists and buckets then grow alike.
BUCKETS = 2_700
#: Blocks, or lists of names, that a Python worker gets at once.
A_BATCH = 16

BLOCK_SCHEMA = "block long, symbols long, row array<long>, doc_id array<long>, copies array<long>, first array<long>, owned array<long>, whole array<boolean>, ends array<long>, data binary"
BLOCK_COLUMNS = [x.split()[0] for x in BLOCK_SCHEMA.split(", ")]
#: What is left of a block: segments with their first symbol's place in the block, and the starts that are candidates.
LEFT_SCHEMA = "block long, owned array<long>, ends array<long>, origin array<long>, data binary, alive binary"
LEFT_COLUMNS = [x.split()[0] for x in LEFT_SCHEMA.split(", ")]


def _longs(x: np.ndarray) -> pa.Array:
    """One row with a list of longs."""
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.asarray(x, np.int64)))


class Block:
    """One block as arrays: segments are [at[i], at[i + 1]); owned: the symbols of each that no other segment has; origin:
    where each began in the whole block; alive: the starts that are still candidates (those that other segments own count
    as such)."""

    def __init__(self, kind: str, data: np.ndarray, ends: np.ndarray, owned: np.ndarray, origin: np.ndarray | None = None, alive: bytes | None = None):
        self.kind, self.data, self.owned = kind, data, owned
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        if kind == "bytes":
            self.at, self.starts_of, self.ends_of, symbols = offsets, None, None, kernel.byte_symbols(data)
        else:
            _, self.starts_of, self.ends_of, self.at = kernel.word_bounds(data, offsets, kind)
            symbols = kernel.word_symbols(data, self.starts_of, self.ends_of)
        self.n = int(self.at[-1])
        self.origin = self.at[:-1] if origin is None else origin
        self.alive = None if alive is None else np.unpackbits(np.frombuffer(alive, np.uint8), count=self.n).astype(bool)
        self.hashes = kernel.Hashes(symbols)

    def open(self, length: int, before: int) -> np.ndarray:
        """Which symbols are owned starts of windows of a length that are still candidates: with before (the length of the
        level before), both the window's first and last part of that length are alive."""
        good = np.ones(self.n, bool)
        stop = np.minimum(self.at[:-1] + self.owned, self.at[1:] - length + 1)
        for a, b, c in zip(self.at[:-1].tolist(), stop.tolist(), self.at[1:].tolist(), strict=True):
            good[max(a, b) : c] = False
        if before and self.alive is not None:
            gap = length - before
            good &= self.alive
            good[: max(0, self.n - gap)] &= self.alive[gap:]
        return good

    def left(self, alive: np.ndarray, length: int, window: int) -> tuple[list[np.ndarray], bytes, bytes]:
        """owned, ends and origin of the runs of symbols that living windows of a length cover, where these could hold the
        longest window; their data and the living starts in them."""
        for a, n, b in zip(self.at[:-1], self.owned, self.at[1:], strict=True):
            alive[a + n : b] = True  # judged in the segment that owns them
        count = np.cumsum(alive, dtype=np.int32)
        keep = np.zeros(self.n + 1, bool)
        keep[:-1] = count > 0
        if self.n > length:
            keep[length:-1] = count[length:] > count[:-length]
        edge = np.zeros(self.n + 1, bool)
        edge[0] = keep[0]
        edge[1:] = keep[1:] != keep[:-1]
        inner = self.at[1:-1]
        edge[inner[keep[inner] & keep[inner - 1]]] = True  # runs end with their segment
        cuts = np.flatnonzero(edge)
        first, last = cuts[:-1][keep[cuts[:-1]]], cuts[1:][keep[cuts[:-1]]]
        wide = last - first >= window
        first, last = first[wide], last[wide]
        segment = np.searchsorted(self.at, first, side="right") - 1
        owned = np.clip(self.at[segment] + self.owned[segment] - first, 0, last - first)
        some = owned > 0
        first, last, owned, segment = first[some], last[some], owned[some], segment[some]
        origin = self.origin[segment] + first - self.at[segment]
        a, b = (first, last) if self.kind == "bytes" else (self.starts_of[first], self.ends_of[last - 1])
        pieces = [self.data[x:y] for x, y in zip(a, b, strict=True)]
        flags = [alive[x:y] for x, y in zip(first, last, strict=True)]
        data = np.concatenate(pieces).tobytes() if pieces else b""
        return [owned, np.cumsum(b - a), origin], data, np.packbits(np.concatenate(flags)).tobytes() if flags else b""


def lengths(window: int) -> list[int]:
    """The lengths of the levels: from a quarter of the window, each at most twice the one before."""
    out = [math.ceil(window / 4)]
    while out[-1] < window:
        out.append(min(window, 2 * out[-1]))
    return out


def build(docs: DataFrame, kind: str, window: int) -> DataFrame:
    """The blocks of a corpus, as a table in the shared folder. Rows equal in doc_id and text are one document with
    copies; rows of one doc_id with other texts are documents of their own, in the order of their texts' hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    overlap, most = window - 1, SEGMENT[kind]
    names = ["row", "doc_id", "copies", "first", "owned", "whole", "ends"]
    types = [pa.list_(pa.bool_() if c == "whole" else pa.int64()) for c in names]

    def segments(data: bytes) -> Iterator[tuple[int, int, bool, bytes]]:
        parts = data.split() if kind == "space" else data
        n = len(parts)
        for a in range(0, max(n, 1), most):
            b = min(n, a + most)
            piece = parts[a : b + overlap]
            yield a, b - a, n <= most, piece if kind == "bytes" else b" ".join(piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        row = number = first
        held: list[tuple] = []
        size = symbols = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, symbols, number
            lists = [pa.array([list(x)], t) for x, t in zip(list(zip(*held, strict=True))[:6], types, strict=False)]
            ends = np.cumsum([len(x[6]) for x in held]).tolist()
            out = pa.RecordBatch.from_arrays([pa.array([number]), pa.array([symbols]), *lists, pa.array([ends], types[6]), pa.array([b"".join(x[6] for x in held)], pa.binary())], BLOCK_COLUMNS)
            held, size, symbols, number = [], 0, 0, number + 1
            return out

        for part in (p for b in batches for p in kernel.slices(b, 64)):
            for doc_id, text, copies in zip(*(c.to_pylist() for c in part.columns), strict=True):
                for at, owned, whole, piece in segments(text.encode()):
                    if held and size + len(piece) > BLOCK:
                        yield flush()
                    held.append((row, doc_id, copies, at, owned, whole, piece))
                    size, symbols = size + len(piece), symbols + owned
                row += 1
        if held:
            yield flush()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    return materialise(sorted_rows.mapInArrow(run, BLOCK_SCHEMA), "blocks", 64)


#: names(block, starts, length, before, second): a name of 64 bits of each start, of which the high ones are used, and a
#: second one (else None). At the first level a name is the window's hash, for any operator.
Names = Callable[[Block, np.ndarray, int, int, bool], tuple[np.ndarray, np.ndarray | None]]


@dataclass(frozen=True)
class Level:
    """One level: windows of a length, made of two of the length before (0: the first level). There are 2**bits buckets."""

    kind: str
    length: int
    before: int
    last: bool
    bits: int
    rounds: int
    names: Names

    @property
    def name_bits(self) -> int:
        return min(64 - PLACE, self.bits + 32)

    def distinct(self, block: Block, low: int = 0, high: int | None = None):
        """Of the buckets low .. high - 1: starts in the order of their names, where each distinct name begins among them,
        the distinct names, and their second names."""
        good = block.open(self.length, self.before)
        shift = 64 - self.bits
        least, most = (U(low << shift), U((high << shift) - 1)) if high is not None else (None, None)
        if self.before or self.last:
            starts = np.flatnonzero(good)
            key, second = self.names(block, starts, self.length, self.before, self.last)
            if high is not None:
                inside = np.flatnonzero((key >= least) & (key <= most))
                starts, key, second = starts[inside], key[inside], None if second is None else second[inside]
        else:
            key, second = block.hashes.run(self.length), None
            good = good[: len(key)]
            if high is not None:
                good &= key >= least
                good &= key <= most
            starts = np.flatnonzero(good)
            key = key[starts]
        mask = U((1 << PLACE) - 1)
        key = (key & ~mask) | np.arange(len(key), dtype=U)
        key.sort()
        place = (key & mask).astype(np.int64)
        key >>= U(64 - self.name_bits)
        place, new = _groups(key, place, None if second is None else second[place])
        heads = np.flatnonzero(new)
        return starts[place], heads, key[heads], None if second is None else second[place[heads]]

    def cuts(self, names: np.ndarray) -> np.ndarray:
        """Where each bucket begins among sorted names, and the end."""
        edges = np.arange(1 << self.bits, dtype=U) << U(self.name_bits - self.bits)
        return np.concatenate([np.searchsorted(names, edges), [len(names)]])


def _groups(key: np.ndarray, place: np.ndarray, second: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, whether each begins a group of equal names) for sorted keys. Where second names differ among equal keys,
    which only chance brings about, the places of these keys are put in the order of their second names."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if second is not None:
        mixed = ~new
        mixed[1:] &= second[1:] != second[:-1]
        if mixed.any():
            group = np.cumsum(new) - 1
            rows = np.flatnonzero(np.isin(group, group[mixed]))
            order = np.lexsort((place[rows], second[rows], group[rows]))
            place, second = place.copy(), second.copy()
            place[rows], second[rows] = place[rows[order]], second[rows[order]]
            new[1:] |= second[1:] != second[:-1]
    return place, new


def _blocks(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[int, Block]]:
    """(row, block) of a batch of blocks, or of what is left of them."""
    column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
    longs = lambda c, i: column[c][i].values.to_numpy(zero_copy_only=False)
    for i in range(batch.num_rows):
        data = np.frombuffer(column["data"][i].as_buffer(), np.uint8)
        whole = "origin" not in column
        yield i, Block(kind, data, longs("ends", i), longs("owned", i), None if whole else longs("origin", i), None if whole else column["alive"][i].as_py())


def _emit(level: Level, first: int, last: int) -> Callable:
    """The lists of names of buckets first .. last - 1, a row a block and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = U((1 << (level.name_bits - level.bits)) - 1)
        for b in batches:
            for i, block in _blocks(b, level.kind):
                _, _, names, second = level.distinct(block, first, last)
                cuts = level.cuts(names)[first : last + 1]
                full = np.flatnonzero(np.diff(cuts))
                if not len(full):
                    continue
                edges = pa.array(np.append(cuts[full], cuts[-1]).astype(np.int32) * 4)
                lists = pa.BinaryArray.from_buffers(pa.binary(), len(full), [None, edges.buffers()[1], pa.py_buffer((names & low).astype(np.uint32))])
                columns = [pa.array((full + first).astype(np.int32)), pa.array(np.full(len(full), b.column(0)[i].as_py())), lists]
                if second is not None:
                    edges = pa.array(np.append(cuts[full], cuts[-1]).astype(np.int32) * 8)
                    columns.append(pa.BinaryArray.from_buffers(pa.binary(), len(full), [None, edges.buffers()[1], pa.py_buffer(second)]))
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "block", "names", "second"][: len(columns)])

    return run


def _merge(last: bool) -> Callable:
    """A mask for each list of a bucket: which names stand in another list or, at the last level, in an earlier one. Rows
    come sorted by bucket, then block."""

    def bucket_of(rows: list[tuple]) -> pa.RecordBatch:
        size = [len(x[2]) // 4 for x in rows]
        key = np.frombuffer(b"".join(x[2] for x in rows), np.uint32).astype(U) << U(32)
        key |= np.arange(len(key), dtype=U)
        key.sort()
        place = (key & U(0xFFFFFFFF)).astype(np.int64)
        key >>= U(32)
        second = np.frombuffer(b"".join(x[3] for x in rows), U)[place] if last else None
        place, new = _groups(key, place, second)
        mask = ~new
        if not last:
            mask[:-1] |= mask[1:]
        bits = np.zeros(len(key), bool)
        bits[place] = mask
        edge = np.concatenate([[0], np.cumsum(size)])
        masks = [np.packbits(bits[a:b]).tobytes() for a, b in zip(edge, edge[1:], strict=False)]
        return pa.RecordBatch.from_arrays([pa.array([x[1] for x in rows]), pa.array([x[0] for x in rows], pa.int32()), pa.array(masks, pa.binary())], ["block", "bucket", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and held[-1][0] != x[0]:
                    yield bucket_of(held)
                    held = []
                held.append(x)
        if held:
            yield bucket_of(held)

    return run


def compare(blocks: DataFrame, level: Level) -> DataFrame:
    """block, bucket, mask of the lists of all blocks at this level: the sorting of one level."""
    spark = blocks.sparkSession
    parts, out = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    inputs = blocks.select(*(c for c in LEFT_COLUMNS if c in blocks.columns))
    each = -(-(1 << level.bits) // level.rounds)
    schema = "bucket int, block long, names binary" + ", second binary" * level.last
    for first in range(0, 1 << level.bits, each):
        lists = inputs.mapInArrow(_emit(level, first, min(1 << level.bits, first + each)), schema)
        dealt = lists.repartitionById(parts, (F.col("bucket") % parts).cast("int")).sortWithinPartitions("bucket", "block")
        masks = materialise(dealt.mapInArrow(_merge(level.last), "block long, bucket int, mask binary"), "masks", A_BATCH)
        out = masks if out is None else out.unionByName(masks)
    return out


def with_masks(blocks: DataFrame, masks: DataFrame) -> DataFrame:
    lists = masks.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "mask"))).alias("masks"))
    return blocks.join(lists, "block")


def marked(level: Level, block: Block, masks: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """(starts, whether each is marked): whose name stands twice or, at the last level, stands earlier."""
    starts, heads, names, _ = level.distinct(block)
    cuts, bits = level.cuts(names), np.zeros(len(heads), bool)
    for mask in masks.as_py():
        a, b = cuts[mask["bucket"]], cuts[mask["bucket"] + 1]
        bits[a:b] = np.unpackbits(np.frombuffer(mask["mask"], np.uint8), count=b - a)
    count = np.diff(np.append(heads, len(starts)))
    marks = np.repeat(bits if level.last else bits | (count > 1), count)
    if level.last:
        own = np.ones(len(starts), bool)
        own[heads] = False  # equal names stand in the order of their places
        marks |= own
    return starts, marks


def survivors(blocks: DataFrame, level: Level, window: int) -> DataFrame:
    """What is left of the blocks after a level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in _blocks(b, level.kind):
                starts, twice = marked(level, block, b.column(b.schema.get_field_index("masks"))[i])
                alive = np.zeros(block.n, bool)
                alive[starts[twice]] = True
                lists, data, flags = block.left(alive, level.length, window)
                if len(data):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *map(_longs, lists), pa.array([data], pa.binary()), pa.array([flags], pa.binary())], LEFT_COLUMNS)

    masks = compare(blocks, level)
    inputs = with_masks(blocks.select(*(c for c in LEFT_COLUMNS if c in blocks.columns)), masks)
    out = materialise(inputs.mapInArrow(run, LEFT_SCHEMA), "candidates", A_BATCH)
    drop(masks)
    return out


def repeats(blocks: DataFrame, level: Level) -> DataFrame:
    """block, starts, counts: the runs of starts, in the whole block, whose windows stand earlier: the last level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, block in _blocks(b, level.kind):
                starts, later = marked(level, block, b.column(b.schema.get_field_index("masks"))[i])
                at = np.sort(starts[later])
                segment = np.searchsorted(block.at, at, side="right") - 1
                at = block.origin[segment] + at - block.at[segment]
                if len(at):
                    first = np.flatnonzero(np.append(True, np.diff(at) != 1))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), _longs(at[first]), _longs(np.diff(np.append(first, len(at))))], ["block", "starts", "counts"])

    masks = compare(blocks, level)
    out = materialise(with_masks(blocks.select(*(c for c in LEFT_COLUMNS if c in blocks.columns)), masks).mapInArrow(run, "block long, starts array<long>, counts array<long>"), "repeats", A_BATCH)
    drop(masks)
    return out


def cut(kind: str, window: int, parts, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, bytes]:
    """(symbols removed, runs of them, what is left) of a text whose windows at these runs of starts go."""
    step = np.zeros(len(parts) + 1, np.int32)
    np.add.at(step, starts, 1)
    np.subtract.at(step, starts + counts - 1 + window, 1)
    gone = np.cumsum(step[:-1]) > 0
    kept = np.frombuffer(parts, np.uint8)[~gone].tobytes() if kind == "bytes" else b" ".join([parts[i] for i in np.flatnonzero(~gone)])
    return int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), kept


def removed(blocks: DataFrame, found: DataFrame, kind: str, window: int) -> DataFrame:
    """doc_id, n, n_removed, n_spans, kept (binary; words joined by one blank) of every document."""
    parts_of = (lambda data: data.split()) if kind == "space" else (lambda data: data)
    result = "doc_id long, copies long, n long, n_removed long, n_spans long, kept binary"
    schema = f"row long, {result}, first long, whole boolean, starts array<long>, counts array<long>"
    names = [x.split()[0] for x in schema.split(", ")]
    longs = pa.list_(pa.int64())
    types = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.bool_(), longs, longs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = {c: b.column(i) for i, c in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                meta = [column[c][i].as_py() for c in ("row", "doc_id", "copies", "first", "owned", "whole", "ends")]
                data = column["data"][i].as_py()
                starts, counts = (column[c][i].values.to_numpy(zero_copy_only=False) if column[c][i].is_valid else np.zeros(0, np.int64) for c in ("starts", "counts"))
                out, byte, symbol, r = [], 0, 0, 0
                for row, doc_id, copies, first, owned, whole, end in zip(*meta, strict=True):
                    piece, byte = data[byte:end], end
                    parts = parts_of(piece)
                    begin, symbol = symbol, symbol + len(parts)
                    stop = int(np.searchsorted(starts, symbol))  # no run goes beyond its segment
                    own, n, r = starts[r:stop] - begin, counts[r:stop], stop
                    if not whole:
                        piece = b" ".join(parts[:owned]) if kind == "space" else piece[:owned]
                        out.append((row, doc_id, copies, owned, 0, 0, piece, first, whole, (own + first).tolist(), n.tolist()))
                    elif len(own):
                        out.append((row, doc_id, copies, owned, *cut(kind, window, parts, own, n), first, whole, None, None))
                    else:
                        out.append((row, doc_id, copies, owned, 0, 0, b" ".join(parts) if kind == "space" else piece, first, whole, None, None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def one(segments: pa.Table) -> pa.Table:
        """A long text from its segments: it is as large as the text itself."""
        segments = segments.sort_by("first").combine_chunks()
        pieces = segments.column("kept").to_pylist()
        parts = b"".join(pieces) if kind == "bytes" else [w for p in pieces for w in p.split()]
        runs = [np.concatenate([np.array(x, np.int64) for x in segments.column(c).to_pylist()]) for c in ("starts", "counts")]
        row = [segments.column("doc_id")[0].as_py(), segments.column("copies")[0].as_py(), len(parts), *cut(kind, window, parts, *runs)]
        return pa.table([pa.array([x], t) for x, t in zip(row, types[1:7], strict=True)], names[1:7])

    done = materialise(blocks.join(found, "block", "left").mapInArrow(run, schema), "segments", A_BATCH)
    drop(blocks)
    drop(found)
    rows = done.where("whole").select(names[1:7]).unionByName(done.where("not whole").groupBy("row").applyInArrow(one, result))
    return rows.select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"), "*").select("doc_id", "n", "n_removed", "n_spans", "kept")


def run_levels(docs: DataFrame, kind: str, window: int, names: Names, rounds: tuple[int, int, int]) -> DataFrame:
    """Doubles from a quarter of the window on; candidates that stand once go at each level, until the window's length is
    reached. With none left, the levels after have nothing to compare."""
    blocks = build(docs, kind, window)
    symbols = blocks.agg(F.sum("symbols")).first()[0] or 0
    left, before, bits = blocks, 0, max(0, round(math.log2(max(1, symbols) / BUCKETS) / 2))
    for length in lengths(window):
        last = length == window
        level = Level(kind, length, before, last, bits, rounds[2] if last else rounds[1] if before else rounds[0], names)
        if last:
            found = repeats(left, level)
            if before:
                drop(left)
            return removed(blocks, found, kind, window)
        old, left = left, survivors(left, level, window)
        if before:
            drop(old)
        before = length
    raise AssertionError("lengths() ends with the window")
