"""Benchmark decontamination by winnowing.

Test items and documents are cut into word k-grams; of every run of 6 neighbouring 5-grams (one window of 10
words) the one of least hash is a fingerprint. Equal windows choose equal fingerprints, so any shared span of
10 words or more meets in the join; an item of fewer words is fingerprinted whole, and documents then show all
their grams of such a length. Where a fingerprint is shared, the windows that chose it are compared: their words
themselves are the key of a second join, so a phrase that many texts share but no window holds makes no pair.
Neighbouring windows that are found extend each other to spans.

The fingerprints, and the windows, of the test set are broadcast only while there are at most BROADCAST of them;
beyond, Spark joins by sorting, which gives the same rows.

Defined cases: a null text has no words and is never contaminated; items without words match nothing; repeated
items count by item_id; a null item_id marks words but is not among the ids, and counts as one item; repeated
documents each get their row; empty tables give no rows, or no hits; other columns are ignored by `report`, and kept
as they are, whatever their names, by `keep_clean`.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import doc_key, keyed, materialise, text_of

WINDOW, GRAM = 10, 5
#: Fingerprints of the test set that may be broadcast (8 bytes each), or windows (some 100 bytes each, a tenth as many).
BROADCAST = 1_000_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().lower())


def _picks(symbols: np.ndarray, at: np.ndarray, short: list[int], whole_rows: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, starts of windows, their fingerprints) of a stream; with whole_rows, short windows only where a
    row is no longer."""
    n, hashes, out = len(symbols), kernel.Hashes(symbols), []
    if n >= WINDOW:
        grams = hashes.all(GRAM)
        start = np.flatnonzero(kernel.windows(at, WINDOW, n))
        out.append((WINDOW, start, grams[kernel.winnow(grams, WINDOW - GRAM + 1)[start]]))
    for m in short:
        start = np.flatnonzero(kernel.windows(at, m, n))
        if whole_rows:
            start = start[np.isin(start, at[:-1][np.diff(at) == m])]
        out.append((m, start, kernel.mix(hashes.at(start, m) ^ np.uint64(m))))
    return out


def _fingerprints(short: list[int]) -> Callable:
    """(f, doc, k): the distinct fingerprints of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, _end, symbols, at in kernel.stream(batch.column(2), "alnum"):
                found = _picks(symbols, at, short, False)
                if not found:
                    continue
                place, f = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
                owner = np.searchsorted(at, place, side="right") - 1
                step = np.concatenate([[True], (owner[1:] != owner[:-1]) | (f[1:] != f[:-1])]) if len(f) else np.zeros(0, bool)
                owner, f = owner[step], f[step]  # neighbouring windows mostly share their pick
                order = np.lexsort((f, owner))
                owner, f = owner[order], f[order]
                new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (f[1:] != f[:-1])]) if len(f) else np.zeros(0, bool)
                owner, f = owner[new] + row, f[new]
                yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(a[owner]), pa.array(b[owner])], ["f", "doc", "k"])

    return run


def _windows(short: list[int], items: bool) -> Callable:
    """(f, words, pos, size, a, b) of the windows of items, or of documents whose windows chose one of the fingerprints
    given in a fourth column."""
    schema = pa.schema([("f", pa.int64()), ("words", pa.binary()), ("pos", pa.int64()), ("size", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in kernel.slices(b, 64)):
            a, b = batch.column(0), batch.column(1)
            wanted = None if items else batch.column(3)
            for row, _end, data, offsets in kernel.pieces(batch.column(2)):
                data, starts, ends, at = kernel.word_bounds(data, offsets, "alnum")
                for m, place, f in _picks(kernel.word_symbols(data, starts, ends), at, short, items):
                    owner = np.searchsorted(at, place, side="right") - 1
                    if wanted is not None:
                        keep = np.zeros(len(place), bool)
                        edge = np.searchsorted(place, at)
                        for i in range(len(at) - 1):
                            part = slice(edge[i], edge[i + 1])
                            keep[part] = np.isin(f[part].view(np.int64), wanted[row + i].values.to_numpy())
                        place, f, owner = place[keep], f[keep], owner[keep]
                    for i in range(0, len(place), 10_000):
                        j = slice(i, i + 10_000)
                        text = [b" ".join(data[x:y].tobytes() for x, y in zip(starts[p : p + m], ends[p : p + m], strict=True)) for p in place[j].tolist()]
                        rows = pa.array(owner[j] + row)
                        yield pa.RecordBatch.from_arrays([pa.array(f[j].view(np.int64)), pa.array(text, pa.binary()), pa.array(place[j] - at[owner[j]]), pa.array(np.full(len(text), m)), a.take(rows), b.take(rows)], schema=schema)

    return run


_WINDOW_ROWS = "f long, words binary, pos long, size long, a long, b long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = np.zeros(b.num_rows, np.int64)
        for row, end, data, offsets in kernel.pieces(b.column(3)):
            n[row:end] = np.diff(kernel.word_bounds(data, offsets, "alnum")[3])
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n)], ["doc_id", "doc", "k", "n_words"])


def _covered(spans: Column) -> Column:
    """How many words the union of spans (pos, size), sorted, covers."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = F.greatest(acc.end, s.pos + s.size)
        return F.struct(end.alias("end"), (acc.n + end - F.greatest(acc.end, s.pos)).alias("n"))

    return F.aggregate(spans, zero, add, lambda acc: acc.n)


def hits(base: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc, k, pos, size, words: the windows of keyed documents that stand in an item, and the items' windows (words, item_id)."""
    items = benchmark.select("item_id", text_of().alias("text"))
    n = F.size(F.filter(F.split(F.lower("text"), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), lambda w: w != ""))
    short = [r.n for r in items.select(n.alias("n")).where(f"n between 1 and {WINDOW - 1}").distinct().collect()]  # nine values at most
    # items are numbered by a hash only to carry their id, of whatever type, beside the window
    of_items = items.select(F.xxhash64("item_id").alias("a"), F.lit(0).cast("long").alias("b"), "text").mapInArrow(_windows(short, True), _WINDOW_ROWS)
    of_items = materialise(of_items.select("f", "words", "a").distinct(), "item-windows")
    f_items, w_items = of_items.select("f").distinct(), of_items.select("words").distinct()
    few = of_items.count() <= BROADCAST // 10
    near = F.broadcast if few else lambda x: x
    f_docs = base.select("doc", "k", "text").mapInArrow(_fingerprints(short), "f long, doc long, k long")
    met = f_docs.join(near(f_items), "f").groupBy("doc", "k").agg(F.collect_set("f").alias("fs"))
    of_docs = base.select("doc", "k", "text").join(met, ["doc", "k"]).select("doc", "k", "text", "fs").mapInArrow(_windows(short, False), _WINDOW_ROWS)
    shared = of_docs.select("words", "pos", "size", F.col("a").alias("doc"), F.col("b").alias("k")).join(near(w_items), "words")
    ids = items.select(F.xxhash64("item_id").alias("a"), "item_id").distinct()
    return materialise(shared, "hits"), of_items.join(ids, "a").select("words", "item_id").distinct()


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; and doc, k, which tell repeated ids apart."""
    base = keyed(docs)
    found, windows = hits(base, benchmark)
    words_hit = found.groupBy("doc", "k").agg(F.sort_array(F.collect_set(F.struct("pos", "size"))).alias("spans"))
    words_hit = words_hit.select("doc", "k", _covered(F.col("spans")).alias("n_hit"))
    # a window that stands often in a document, or in many items, is one row a document first
    named = found.select("doc", "k", "words").distinct().join(windows, "words").select("doc", "k", "item_id").distinct()
    named = named.groupBy("doc", "k").agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    of_doc = words_hit.join(named, ["doc", "k"]).select("doc", "k", "n_hit", "n_items", F.sha2(F.array_join("ids", ","), 256).alias("ids"))
    every = base.mapInArrow(_count, "doc_id long, doc long, k long, n_words long")
    zero = F.lit(0).cast("long")
    return every.join(of_doc, ["doc", "k"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("ids", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"), "doc", "k")


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of any item, with all their columns."""
    found, _ = hits(keyed(docs), benchmark)
    bad = found.select(F.struct("doc", "k").alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.struct(doc_key().alias("doc"), F.xxhash64(text_of()).alias("k")).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")
