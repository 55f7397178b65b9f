"""Telemetry as it arrives: a folder of subtitle logs is followed, and each batch of new files becomes samples.

An extra: survey engines of this kind run in batches. A batch writes a folder of its own name, overwriting what an
earlier attempt left, so a restart neither loses nor repeats files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.telemetry import parse_srt


def follow_srt(spark: SparkSession, folder: str, out: str, checkpoint: str, pattern: str = "*.[sS][rR][tT]", once: bool = False) -> StreamingQuery:
    """Starts the query; once: takes what is there and ends."""
    files = spark.readStream.schema("value string").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    named = files.select(F.col("_metadata.file_name").alias("track"), F.lit(0).alias("track_order"), "value")

    def save(batch: DataFrame, number: int) -> None:
        parse_srt(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = named.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
