"""The scan as a stream of files: what a batch scan finds, one micro-batch after another."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def scan_stream(files: DataFrame, scan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, budget: float | None = None) -> StreamingQuery:
    """Each file once: its hash and findings go to ``out`` as Parquet, partitioned by batch, so that a repeated batch replaces itself.

    ``scan`` takes a batch of files and returns findings with a path column; it
    sees each distinct content once, those of earlier batches left out. A batch
    that fails is written to ``errors`` and the stream goes on. ``budget``:
    seconds after which no more batches are scanned; what came later is written
    with complete = false.
    """
    begin = time.monotonic()

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.withColumn("content_hash", F.sha2("content", 256))
        late = budget is not None and time.monotonic() - begin > budget
        listed = rows.select("path", "length", "content_hash", F.lit(not late).alias("complete"))
        listed.write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        if late:
            return
        first = rows.groupBy("content_hash").agg(F.min("path").alias("path")).select(F.col("path").alias("first_path"), F.col("content_hash").alias("first_hash"))
        before = spark.read.schema("path string, length long, content_hash string, complete boolean, batch int").parquet(f"{out}/files").where((F.col("batch") < number) & F.col("complete"))
        first = first.join(before.select(F.col("content_hash").alias("seen")), F.col("first_hash") == F.col("seen"), "left_anti")
        try:
            found = scan(rows.join(first, F.col("path") == F.col("first_path"), "left_semi"))
            found.write.mode("overwrite").parquet(f"{out}/findings/batch={number}")
        except Exception as e:
            text = f"{type(e).__name__}: {e}"[:1000]
            spark.createDataFrame([(number, text)], "batch int, error string").write.mode("overwrite").parquet(f"{out}/errors/part={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(spark: SparkSession, out: str) -> DataFrame:
    """The end of a stream, one row: files_scanned, bytes_scanned, aggregate_hash of all distinct contents, has_errors, analysis_complete."""
    from ..operators.groups import aggregate_hash

    files = spark.read.schema("path string, length long, content_hash string, complete boolean, batch int").parquet(f"{out}/files")
    totals = files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes_scanned"), F.coalesce(F.bool_and("complete"), F.lit(True)).alias("analysis_complete"))
    digest = aggregate_hash(files.select("content_hash").distinct(), "content_hash").select("aggregate_hash")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/errors")
    failed = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return totals.crossJoin(digest).withColumn("has_errors", F.lit(failed) | ~F.col("analysis_complete"))  # one row each


def running_totals(events: DataFrame, key: str) -> DataFrame:
    """Running counts of a stream by key, for complete mode."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts by time window and key; rows later than the watermark are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
