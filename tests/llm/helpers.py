"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ["doc", "k", "key", "h", "x", "root", "node", "f", "d", "start", "n", "p", "component_id", "item", "items", "kept", "words", "part", "bytes", "shard", "label", "_k", "_d", "_h"]
LONG = " ".join(f"word{i % 997} and{i}" for i in range(12_000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], SCHEMA)


AWKWARD = [
    (None, "a text without an id that is long enough to be looked at by all of the rules here"), (0, None), (1, ""), (2, "   \n\t "), (3, "one"), (4, LONG),
    (5, "the same text stands here twice and it has more than ten words in it"), (6, "the same text stands here twice and it has more than ten words in it"),
    (7, "a row that is repeated exactly, id and all, with more than ten words"), (7, "a row that is repeated exactly, id and all, with more than ten words"),
    (8, "Ünïcödé wörds – and “marks” 😀 of several kinds, in no language at all, twelve words"), (8, "another text of the id eight, which is no copy of the first one at all"), (None, None), (9, "\u0000 nul  and odd\x0b blanks\x85 in\x1c this text of some ten words or more"),
]


def awkward(spark, clash=True):
    df = table(spark, AWKWARD)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clash else df


def empty(spark):
    return table(spark, [(1, "x")]).where("doc_id < 0")
