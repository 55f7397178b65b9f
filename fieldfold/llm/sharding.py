"""Sharding by extendible hashing: a directory over hash-prefix bits, in which only oversized buckets split.

A document's hash is the first 36 bits of the MD5 of its id, then the first 24 of the MD5 of its text, which tell
rows of one id (or of none) apart. A bucket of more than the byte limit splits on the next bit, and so on until every
bucket fits; a bucket whose documents all share one hash can't be split and stays (oversized only when a single
document, or rows equal in id and text, exceed the limit). Bytes are summed by prefix
first, so the splitting works on a histogram of about 64 cells a shard; buckets that are still too large at
its depth go another round with more bits, alone.

Defined cases: a null text has no bytes; a null doc_id hashes as the word null; rows equal in id and text share a
shard; an empty table gives no rows; other columns are kept as they are by `assign`, but for those with the names of
its own results (n_bytes, shard_depth, shard, shard_bytes), which give way to these. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

ID_BITS, TEXT_BITS = 36, 24
BITS = ID_BITS + TEXT_BITS
OWN = ("n_bytes", "shard_depth", "shard", "shard_bytes")
#: The shard size for files; callers pass their own limit.
LIMIT = 128 << 20


def hash_bits() -> Column:
    hex_digits = lambda c, bits: F.conv(F.substring(F.md5(c), 1, bits // 4), 16, 10).cast("long")
    of_id = hex_digits(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), ID_BITS)
    return F.shiftleft(of_id, TEXT_BITS).bitwiseOR(hex_digits(text_of(), TEXT_BITS))


def _prefix(h: Column, bits) -> Column:
    return F.shiftrightunsigned(h, BITS - bits) if isinstance(bits, int) else F.expr(f"shiftrightunsigned({h}, {BITS} - {bits})")


def directory(hashed: DataFrame, limit: int) -> DataFrame:
    """The leaf buckets depth, prefix, shard_bytes over rows (h, bytes)."""
    total = hashed.agg(F.sum("bytes")).first()[0] or 0
    depth = min(BITS, max(6, (total // limit).bit_length() + 6))
    open_, low, leaves = hashed, 0, None
    while True:
        cells = open_.groupBy(_prefix(F.col("h"), depth).alias("cell")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        each = cells.select("bytes", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("depth"), "cell").selectExpr("bytes", "lo", "hi", "depth", f"shiftrightunsigned(cell, {depth} - depth) AS prefix")
        nodes = materialise(each.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), (F.min("lo") == F.max("hi")).alias("single")).withColumn("fits", (F.col("shard_bytes") <= limit) | F.col("single") | (F.col("depth") == BITS)), "nodes")
        parents = nodes.where("not fits").selectExpr("depth + 1 AS depth", "prefix AS parent")
        leaf = nodes.where("fits").withColumn("parent", F.shiftrightunsigned("prefix", 1))
        below = leaf.join(parents, ["depth", "parent"], "left_semi")
        found = below if low else below.unionByName(leaf.where("depth = 0"))
        found = found.select("depth", "prefix", "shard_bytes")
        leaves = found if leaves is None else leaves.unionByName(found)
        large = nodes.where(f"depth = {depth} and not fits").select(F.col("prefix").alias("cell"))
        if depth >= BITS or large.limit(1).count() == 0:
            return leaves
        open_ = open_.withColumn("cell", _prefix(F.col("h"), depth)).join(large, "cell", "left_semi").drop("cell")
        low, depth = depth, min(BITS, depth + 8)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, shard_depth, shard (its bits, "" where one bucket holds all) and shard_bytes."""
    size = F.octet_length(text_of()).cast("long")
    leaves = materialise(directory(docs.select(hash_bits().alias("h"), size.alias("bytes")), limit), "leaves")
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect())  # at most 61 values
    rows = docs.select(F.struct("*").alias("row"), hash_bits().alias("h"), size.alias("n_bytes"))
    # a row looks up its prefix at each depth that has leaves; one of them is there
    keys = rows.withColumn("at", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _prefix(F.col("h"), d).alias("prefix")) for d in depths or [0]))))
    of = leaves.select(F.struct("depth", "prefix").alias("at"), "shard_bytes")
    bits = F.when(F.col("at.depth") == 0, "").otherwise(F.expr("lpad(conv(at.prefix, 10, 2), at.depth, '0')"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in OWN]
    return keys.join(of, "at").select(*kept, "n_bytes", F.col("at.depth").alias("shard_depth"), bits.alias("shard"), "shard_bytes")
