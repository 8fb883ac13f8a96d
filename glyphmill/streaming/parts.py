"""Resumable processing of part files as a stream (the chunked page commands; K3, K4, D6 over all parts).

New files in a folder are read once; what was read is kept in the checkpoint, so a run that breaks goes on where it was.
Repeated pairs are dropped across all files by their hash in the stream's state, so that a resumed run forgets none. The
state holds a hash for each different pair; with a watermark on an arrival time it is bounded by time instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.functions import text as X
from glyphmill.shared import shared_path


def pair_hash(src: str, tgt: str):
    """L10."""
    return F.md5(F.concat_ws("\t", X.text_or_empty(F.col(src)), X.text_or_empty(F.col(tgt))))


def arriving(spark: SparkSession, folder: str, schema, files_at_once: int = 64) -> DataFrame:
    """The rows of Parquet files in folder and those that come later, so many files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def without_repeats(rows: DataFrame, src: str = "src_sent", tgt: str = "tgt_sent", arrived: str | None = None, within: str = "7 days") -> DataFrame:
    """Rows whose pair has not been seen; with an arrival column, not within that time."""
    rows = rows.withColumn("pair_hash", pair_hash(src, tgt))
    return rows.withWatermark(arrived, within).dropDuplicatesWithinWatermark(["pair_hash"]) if arrived else rows.dropDuplicates(["pair_hash"])


def write_parts(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Start writing a stream to a folder of Parquet files until what is there now has been read."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def distinct_pairs(spark: SparkSession, folder: str, schema, src: str, tgt: str, out: str | None = None) -> DataFrame:
    """The distinct pairs of all files in folder, by a stream that ends with them; out: a folder that later runs add to."""
    out = out or shared_path(spark, "distinct-pairs")
    write_parts(without_repeats(arriving(spark, folder, schema), src, tgt), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def counted_by_window(events: DataFrame, time: str, key: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows of each key in windows of a time column; rows later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
