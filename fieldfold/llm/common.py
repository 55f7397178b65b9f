"""Session helpers shared by the operators: the shared folder, lineage cuts, text normalisation."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null doc_id sorts before every other id; this stands in for it while positions are compared.
NULL_ID = -(2**63)

_own_dirs: dict[str, str] = {}
_cleaned: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where it is unset, a local session gets a folder of its own;
    on a cluster that is an error, as executors would write to their own disks."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="fieldfold-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


def _clean(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:
        remove(spark, folder)


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder. What this application has left there goes when it ends."""
    app = spark.sparkContext.applicationId
    if app not in _cleaned:
        _cleaned.add(app)
        atexit.register(_clean, spark, f"{shared_dir(spark)}/fieldfold/{app}")
    return f"{shared_dir(spark)}/fieldfold/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the queries that run inside, put back afterwards."""
    names = {k: k.replace("__", ".") for k in values}
    before = {n: spark.conf.get(n, None) for n in names.values()}
    for k, v in values.items():
        spark.conf.set(names[k], v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def materialise(df: DataFrame, name: str, rows_a_batch: int | None = None) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder: it survives lost executors, and Spark removes the
    shuffle files of the query once it is written. rows_a_batch: rows that Python workers get at once, where rows are large."""
    spark = df.sparkSession
    path = new_path(spark, name)
    wanted = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
    if rows_a_batch:
        wanted["spark__sql__execution__arrow__maxRecordsPerBatch"] = str(rows_a_batch)
    with settings(spark, **wanted):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Deletes what materialise() made of a table that no later step reads; files of anyone else stay."""
    own = f"/fieldfold/{df.sparkSession.sparkContext.applicationId}/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if own in path:
            remove(df.sparkSession, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str | Column = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def doc_key(col: str = "doc_id") -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc, k, text: k tells rows of one doc_id and other texts apart; rows equal in both have one key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc"), F.xxhash64(text_of()).alias("k"), text_of().alias("text"))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row, whatever the optimiser makes of projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def space_words(text: Column) -> Column:
    """The words [^ \\t-\\r]+ of a text as an array of strings."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other characters as they are. lower() does that where all is ASCII; where other
    letters stand in the text, only they go through translate()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
