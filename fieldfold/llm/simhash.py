"""SimHash near-duplicates by a binary trie self-join.

Fingerprints that differ in at most three bits agree wholly on one of four quarters of their bits. So each fingerprint is
dealt four times, by a quarter's number and bits, whatever the size of the corpus; a group that is still too large is dealt
again, twice at most, by quarters of the bits that its members don't share yet. A task walks the tries of its groups: pairs of nodes go down
together, a bit a level, with the differing bits so far, and go once these exceed the budget, once either node is empty,
or once all below is one component anyway; nodes of few fingerprints are compared one by one. A task returns a spanning
forest of its links, and Spark joins the forests to components.

`report` links fingerprints of three-word shingles at three bits. `keep_one` finds near copies, texts of five-word
shingles alike by 0.8 or more: those whose sketches of WIDE x 64 bits of five-word shingles differ in WIDE_APART bits at
most. Such texts differ by few words, so their candidates are pairs within three bits in one of TABLES fingerprints of
single words, each found by the trie join; a pair's sketches are compared where it is found, and no pair leaves a task
but as a link of the forest.

Defined cases: a null text is empty; texts without words are copies of each other (fingerprint zero in `report`, linked
like any other); repeated rows have one fingerprint and so one component; a null doc_id gets a component but never names
one unless it has no other; an empty table gives no rows; other columns are ignored by `near_duplicates` and kept as they
are, whatever their names, by `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import doc_key, drop, materialise, text_of
from .components import components
from .kernel import slices

SEED, SHINGLE, BITS_APART = 42, 3, 3
#: Near copies: words of a shingle, 64-bit words of a sketch, the bits that it may differ in (similarity 0.8 expects 39 of
#: 256, texts of no relation some 120), and the fingerprints of single words in which candidates are looked for.
ALIKE_SHINGLE, WIDE, WIDE_APART, TABLES = 5, 4, 44, 5
#: Fingerprints in a group at most (larger groups are dealt again), rows that one task walks at once, about, and pairs of
#: fingerprints below a pair of nodes that are compared one by one.
A_GROUP, A_TASK, FEW = 1 << 15, 1 << 17, 64
_ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_PLACE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(SHINGLE, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts, at = np.zeros((8, 8), np.int64), 0
    while at < n:  # long texts in parts
        stop = min(n, at + 500_000)
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:stop].tolist(), ends[at + size - 1 : stop + size - 1].tolist(), strict=True)), np.uint64, stop - at)
        by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.bincount((by_byte + _PLACE).ravel(), minlength=2048).reshape(8, 256) @ _ONES
        at = stop
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, f (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(t) for part in slices(b) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, f long")


class _Forest:
    """Components over positions of a sorted array, and which ranges are within one."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self._count()

    def _count(self) -> None:
        self.changes = np.concatenate([[0], np.cumsum(self.root[1:] != self.root[:-1])])

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            high, low = np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart]
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        self.root = root
        self._count()

    def joined(self, a0, a1, b0, b1) -> np.ndarray:
        """Whether all of two ranges is one component."""
        c = self.changes
        return (c[a0] == c[a1 - 1]) & (c[b0] == c[b1 - 1]) & (self.root[a0] == self.root[b0])


class Walk:
    """The links among groups of fingerprints: f sorted within each group [cuts[i], cuts[i + 1]). wide: sketches (rows) that
    must differ in wide_apart bits at most, too."""

    def __init__(self, f: np.ndarray, cuts: np.ndarray, apart: int, wide: np.ndarray | None = None, wide_apart: int = 0, chunk: int = 1 << 17):
        self.f, self.cuts, self.apart, self.wide, self.wide_apart, self.chunk = f, cuts, apart, wide, wide_apart, chunk
        self.forest = _Forest(len(f))
        self.ones: dict[int, np.ndarray] = {}

    def _split(self, lo: np.ndarray, hi: np.ndarray, d: int) -> np.ndarray:
        """Where the ones of bit d begin in nodes [lo, hi)."""
        if d not in self.ones:
            self.ones[d] = np.concatenate([[0], np.cumsum((self.f >> np.uint64(63 - d)) & np.uint64(1))]).astype(np.int64)
        ones = self.ones[d]
        return hi - (ones[hi] - ones[lo])

    def _compare(self, a0, a1, b0, b1) -> None:
        """Compares all fingerprints of pairs of nodes, some pairs at a time."""
        left, right = a1 - a0, b1 - b0
        count = left * right
        edge = np.concatenate([[0], np.cumsum(count)])
        for i in range(0, int(edge[-1]), self.chunk):
            j = np.arange(i, min(i + self.chunk, int(edge[-1])))
            node = np.searchsorted(edge, j, side="right") - 1
            at = j - edge[node]
            x, y = a0[node] + at // right[node], b0[node] + at % right[node]
            ahead = self.forest.root[x] != self.forest.root[y]
            x, y = x[ahead], y[ahead]
            near = np.bitwise_count(self.f[x] ^ self.f[y]) <= self.apart
            x, y = x[near], y[near]
            if self.wide is not None and len(x):
                near = np.bitwise_count(self.wide[x] ^ self.wide[y]).sum(1) <= self.wide_apart
                x, y = x[near], y[near]
            if len(x):
                self.forest.link(x, y)

    def roots(self) -> np.ndarray:
        """The component root (a position) of each position."""
        a0, a1 = self.cuts[:-1], self.cuts[1:]
        stack = [(0, a0[i : i + self.chunk], a1[i : i + self.chunk], a0[i : i + self.chunk], a1[i : i + self.chunk], np.zeros(len(a0[i : i + self.chunk]), np.int64)) for i in range(0, len(a0), self.chunk)]
        while stack:
            d, a0, a1, b0, b1, diff = stack.pop()
            same = a0 == b0
            keep = (a1 > a0) & (b1 > b0) & (diff <= self.apart) & ~(same & (a1 - a0 == 1))
            a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                continue
            keep = ~self.forest.joined(a0, a1, b0, b1)
            a0, a1, b0, b1, diff = (x[keep] for x in (a0, a1, b0, b1, diff))
            few = (a1 - a0) * (b1 - b0) <= FEW
            if d == 64:
                few[:] = True
            if few.any():
                self._compare(a0[few], a1[few], b0[few], b1[few])
                a0, a1, b0, b1, diff = (x[~few] for x in (a0, a1, b0, b1, diff))
            if not len(a0):
                continue
            same = a0 == b0
            am, bm = self._split(a0, a1, d), self._split(b0, b1, d)
            far = (np.concatenate([a0, am[~same]]), np.concatenate([am, a1[~same]]), np.concatenate([bm, b0[~same]]), np.concatenate([b1, bm[~same]]), np.concatenate([diff, diff[~same]]) + 1)
            near = (np.concatenate([a0, am]), np.concatenate([am, a1]), np.concatenate([b0, bm]), np.concatenate([bm, b1]), np.concatenate([diff, diff]))
            for group in (far, near):  # near pairs are walked first: they join what then need not be compared
                for i in range(0, len(group[0]), self.chunk):
                    stack.append((d + 1, *(v[i : i + self.chunk] for v in group)))
        return self.forest.root


def trie_join(sorted_f: np.ndarray, apart: int, chunk: int = 1 << 17) -> np.ndarray:
    """The component root (a position) of each of the sorted fingerprints, by links within apart bits."""
    return Walk(sorted_f, np.array([0, len(sorted_f)]), apart, chunk=chunk).roots()


def _masks(shift: int) -> list[int]:
    """The 64 bits in four masks, by two bits of their number, as signed longs."""
    each = [sum(1 << p for p in range(64) if p >> shift & 3 == i) for i in range(4)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in each]


def dealt(rows: DataFrame) -> DataFrame:
    """rows (f and more) with key: each row four times, by the bits of a quarter of f. Rows of groups over A_GROUP are dealt
    again by quarters of the 48 bits that the group doesn't share, and once more by quarters of the 36 left."""
    open_, out = rows.withColumns({"key": F.lit(0).cast("long"), "free": F.lit(-1).cast("long")}), None
    for shift in (4, 0, 2):
        parts = [F.struct(F.xxhash64("key", F.lit(shift + i), F.col("f").bitwiseAND(F.lit(m)).bitwiseAND(F.col("free"))).alias("key"), F.col("free").bitwiseAND(F.lit(~m)).alias("free")) for i, m in enumerate(_masks(shift))]
        open_ = open_.select(*rows.columns, F.explode(F.array(*parts)).alias("to")).select(*rows.columns, "to.*")
        if shift == 2:
            break
        large = materialise(open_.groupBy("key").count().where(F.col("count") > A_GROUP).select("key"), "large-groups")
        if large.limit(1).count() == 0:
            break
        fits = open_.join(large, "key", "left_anti").select(*rows.columns, "key", "free")
        out = fits if out is None else out.unionByName(fits)
        open_ = open_.join(large, "key", "left_semi")
    return (open_ if out is None else out.unionByName(open_)).drop("free")


def links(rows: DataFrame, apart: int, wide_apart: int | None = None) -> DataFrame:
    """A spanning forest (a, b) over node of the links between rows (node, f, and sketches w0 .. where wide_apart is given)."""
    wide = [c for c in rows.columns if c.startswith("w")]
    groups = dealt(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * rows.count() // A_TASK))

    def walk(table: pa.Table) -> pa.Table:
        f, key = table.column("f").to_numpy().view(np.uint64), table.column("key").to_numpy()
        order = np.lexsort((f, key))
        f, key, node = f[order], key[order], table.column("node").to_numpy()[order]
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        sketch = np.stack([table.column(c).to_numpy().view(np.uint64)[order] for c in wide], 1) if wide_apart is not None else None
        root = Walk(f, cuts, apart, sketch, wide_apart or 0).roots()
        linked = np.flatnonzero(root != np.arange(len(f)))
        return pa.table({"a": node[linked], "b": node[root[linked]]})

    return groups.withColumn("task", F.pmod("key", F.lit(parts))).groupBy("task").applyInArrow(walk, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, f, component_id: the smallest doc_id that links reach (null where none has one; repeated doc_ids can give
    several components the same)."""
    of_docs = materialise(fingerprints(docs), "fingerprints")
    distinct = materialise(of_docs.groupBy("f").agg(F.min("doc_id").alias("d")), "distinct-fingerprints")
    found = components(materialise(links(distinct.select(F.col("f").alias("node"), "f"), BITS_APART), "links"))
    rooted = distinct.join(found, distinct.f == found.node, "left").select("f", "d", F.coalesce("root", "f").alias("root"))
    named = rooted.groupBy("root").agg(F.min("d").alias("component_id"))
    of_f = rooted.join(named, "root").select("f", "component_id")
    return of_docs.join(of_f, "f").select("doc_id", "f", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def _bits(features: np.ndarray, first: np.ndarray, n: np.ndarray, seed: int) -> np.ndarray:
    """The fingerprint of each row's features [first, first + n): a bit is set where over half of them have it."""
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(kernel.mix(features ^ np.uint64(seed)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts = np.add.reduceat(bits, first[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(counts * 2 > n[some, None], axis=1).view(">u8").ravel()
    return out


_SEEDS = np.random.default_rng(20250103).integers(0, 2**63, 64).tolist()


def sketches(texts: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, [TABLES fingerprints of words, WIDE words of the sketch of shingles]) of runs of texts, A-Z in
    lower case."""
    for row, end, data, offsets in kernel.pieces(texts):
        data, starts, ends, at = kernel.word_bounds(kernel.lower(data), offsets, "space")
        words = kernel.word_symbols(data, starts, ends)
        n = np.diff(at)
        hashes = kernel.Hashes(words)
        m = np.where(n >= ALIKE_SHINGLE, n - ALIKE_SHINGLE + 1, np.minimum(n, 1))
        first = np.cumsum(m) - m
        owner = np.repeat(np.arange(end - row), m)
        place = at[owner] + np.arange(len(owner)) - first[owner]
        shingles = hashes.at(place, np.minimum(ALIKE_SHINGLE, n[owner]))
        yield row, end, [_bits(words, at[:-1], n, s) for s in _SEEDS[:TABLES]] + [_bits(shingles, first, m, s) for s in _SEEDS[TABLES : TABLES + WIDE]]


def sketched(docs: DataFrame) -> DataFrame:
    """node (a hash of a text's sketches), w0 .., f0 .. of the distinct sketches, and of every document (doc, k) its node."""
    names = [*(f"f{i}" for i in range(TABLES)), *(f"w{i}" for i in range(WIDE))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 1024)):
            doc, k = b.column(0), b.column(1)
            for row, end, found in sketches(b.column(2)):
                yield pa.RecordBatch.from_arrays([doc.slice(row, end - row), k.slice(row, end - row), *(pa.array(x.view(np.int64)) for x in found)], ["doc", "k", *names])

    out = docs.select(doc_key().alias("doc"), F.xxhash64(text_of()).alias("k"), text_of().alias("text")).mapInArrow(run, "doc long, k long, " + ", ".join(f"{c} long" for c in names))
    return out.withColumn("node", F.xxhash64(*names))


def near_copies(docs: DataFrame) -> DataFrame:
    """doc, k, root: documents (by doc_id and text hash) with the node that names their group of near copies."""
    of_docs = materialise(sketched(docs), "sketches")
    nodes = materialise(of_docs.drop("doc", "k").dropDuplicates(["node"]), "distinct-sketches")
    wide, forest = [f"w{i}" for i in range(WIDE)], None
    for i in range(TABLES):
        found = materialise(links(nodes.select("node", F.col(f"f{i}").alias("f"), *wide), BITS_APART, WIDE_APART), "links")
        forest = found if forest is None else forest.unionByName(found)
    found = components(forest.distinct())
    drop(nodes)
    return of_docs.select("doc", "k", "node").join(found, "node", "left").select("doc", "k", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The document of each group of near copies with the smallest doc_id (of rows that share it, the one of least text
    hash, once), with all its columns."""
    best = near_copies(docs).groupBy("root").agg(F.min(F.struct("doc", "k")).alias("key")).select("key")
    rows = docs.select(F.struct("*").alias("row"), F.struct(doc_key().alias("doc"), F.xxhash64(text_of()).alias("k")).alias("key"))
    kept = rows.join(best, "key", "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.groupBy("key").agg(F.first("row").alias("row"))
    return kept.select("row.*")
