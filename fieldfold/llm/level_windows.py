"""Exact removal of repeated passages of words by level-wise doubling.

Windows of 5 words that stand once in the corpus can't be part of a longer repeated one: only windows repeated at one
length are extended to twice that length, 5 to 10 to 20 words. A window of 2w words is a candidate where the windows of
w words at its start and at its middle are both repeated; its name is the rolling hash of all its words, with the pair of
its halves' names beside it at the last length. Of the windows of 20 words that stand more than once, all but the first go. See `blocks` for how names
are compared, and for texts that are longer than a block.

Defined cases: as in `suffix_ranks`, with words [^ \\t-\\r]+ in place of bytes; a text of fewer words has no windows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from . import kernel
from .blocks import Block, run_levels

WINDOW = 20


def window_names(block: Block, starts: np.ndarray, length: int, before: int, second: bool) -> tuple[np.ndarray, np.ndarray | None]:
    whole = block.hashes.plain(starts, length)
    if not second:
        return whole, None
    half = length // 2
    return whole, kernel.pair(block.hashes.plain(starts, half), block.hashes.plain(starts + half, length - half), True)[1]


def deduplicate(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n (words), n_removed, n_spans (maximal removed runs), kept (binary: words joined by one blank) of every document."""
    return run_levels(docs, "space", window, window_names, (1, 1, 1))
