"""Exact removal of repeated byte strings by distributed prefix doubling.

Every position of the corpus (of every suffix) has a rank for its first k bytes. Ranks of 25 bytes come first; then the
pairs (rank[i], rank[i + k]) at growing offsets k = 25, 50 are sorted over the cluster, equal pairs become one rank of 2k
bytes, and positions whose rank stands once in the corpus are dropped, as no longer prefix of theirs can repeat. Past the
threshold (100 bytes) what is left is grouped by rank: all but the first position of a group are repeats.

A rank is a name of its string (a rolling hash), not its place in the order: ranks of a third of all positions needn't
be stored, as any task works them out from the text, and the candidates are kept as one bit a position. Past the
threshold both ranks of a pair count with all their 64 bits. See `blocks` for how the pairs are sorted, and for texts
that are longer than a block.

Defined cases: a null or empty text has no positions; a null doc_id comes before all others; rows equal in doc_id and
text are one document, whose result each row gets; rows of one doc_id with other texts are documents of their own, in
the order of their texts' hashes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import kernel
from .blocks import Block, run_levels

WINDOW = 100


def rank_pairs(block: Block, starts: np.ndarray, length: int, before: int, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """The ranks of strings of a length: of the pair of ranks at i and at i + offset; at first, of the string itself."""
    if not before:  # only where the first level is the last
        whole = block.hashes.plain(starts, length)
        return whole, kernel.mix(whole)
    return kernel.pair(block.hashes.plain(starts, before), block.hashes.plain(starts + (length - before), before), second)


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n (bytes), n_removed, n_spans (maximal removed runs), kept (binary) of every document."""
    return run_levels(docs, "bytes", window, rank_pairs, (3, 1, 3))
