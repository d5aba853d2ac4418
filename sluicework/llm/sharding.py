"""Sharding by rendezvous hashing, with DataFrame functions only.

Every shard draws a number for a record's key, -ln(u) / weight with u the
key's and the shard's hash as a fraction, and the least number wins. So a shard
gets its weight's share of the keys, the key and the shard list alone decide,
and a further shard takes rows only into itself.

Slots number the rows of each shard without a gap. A window over whole shards
would put a sixteenth of all rows into one task, so rows are numbered within
(input partition, shard) and each such run starts where the runs before it in
that shard end. The light rows (key, size, checksum, shard) are written once,
so both passes see the same runs; the text is read once and never shuffled.

Defined results. A null doc_id is the key of the empty string. A null text has
size 1 and checksum 0. Rows that repeat a key go to one shard and get slots of
their own, however many they are. An empty table gives an empty result. Very long
texts are read whole, by the JVM. Columns of other names are not looked at; a key
column that is named like an output gets underscores before its name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept, stored, table

SHARDS = 16


def draw(key: Column, shard: int, weight: float) -> Column:
    """What a shard draws for a key; the least wins."""
    u = (F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(shard)), 11) + 0.5) / float(2**53)
    return -F.log(u) / weight


def winner(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins. A weight of 0 takes the shard out, and the other shards keep their rows."""
    if not any(w > 0 for w in weights):
        raise ValueError("one weight must be above 0")
    return F.array_min(F.array(*[F.struct(draw(key, i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0])).getField("shard")


def number(rows: DataFrame, shard: str = "shard", order: str = "row_id") -> DataFrame:
    """Adds slot: gapless from 0 in each shard. ``order``: a monotonically increasing id, already written."""
    run = F.shiftright(F.col(order), 33)
    rows = rows.withColumn("run", run)
    sizes = rows.groupBy(F.col("run").alias("of_run"), F.col(shard).alias("of_shard")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("of_shard").orderBy("of_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = rows.withColumn("place", F.row_number().over(Window.partitionBy("run", shard).orderBy(order)) - 1)
    out = own.join(starts, (F.col("run") == F.col("of_run")) & (F.col(shard) == F.col("of_shard")))
    return out.withColumn("slot", (F.col("start") + F.col("place")).cast("long")).drop("run", "of_run", "of_shard", "n", "start", "place")


_OUT = ["size", "text_crc32", "shard", "slot", "grown_shard"]


def shards(docs: DataFrame, weights: Sequence[float] = (1.0,) * SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot, grown_shard (with one more shard of weight 1)."""
    key = F.col("key_")
    light = docs.select(
        F.col(doc_id).alias("key_"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    light = light.withColumns({"shard": winner(key, weights), "grown_shard": winner(key, [*weights, 1.0]), "row_id": F.monotonically_increasing_id()})
    return number(stored(light)).select("key_", *_OUT).toDF(*kept([doc_id], _OUT), *_OUT)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
