"""Files by content: groups, representatives, the order-free hash of all, and the result cache."""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from ..functions import classify as K
from ..functions import tables as T
from ..functions.detect import license_array


def _digest(content: str, path: str) -> Column:
    return F.coalesce(F.sha2(F.col(content).cast("binary"), 256), F.concat(F.lit("unhashable_"), path))


PATHS = 1000


def content_groups(files: DataFrame, path: str, content: str) -> DataFrame:
    """content_hash, n_files, location (all paths in order), first_path. What can't be read is a group of its own.

    Paths are put in order within ranges of PATHS and the ranges joined, so that
    the files of a content that very many share aren't sorted in one array; the
    text of all paths is what the group's row has to hold.
    """
    rows = files.select(_digest(content, path).alias("content_hash"), F.col(path).alias("p"))
    place = F.row_number().over(Window.partitionBy("content_hash").orderBy("p")) - 1
    parts = rows.withColumn("part", F.floor(place / PATHS)).groupBy("content_hash", "part").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("p")), " ").alias("l"), F.min("p").alias("f"))
    groups = parts.groupBy("content_hash").agg(F.sum("n").alias("n_files"), F.array_sort(F.collect_list(F.struct("part", "l"))).alias("l"), F.min("f").alias("first_path"))
    return groups.select("content_hash", "n_files", F.array_join(F.transform("l", lambda x: x["l"]), " ").alias("location"), "first_path")


def duplicates(files: DataFrame, path: str, content: str) -> DataFrame:
    """Each file with its group: content_hash, group_size, first_path, is_duplicate. No array: every copy is a row."""
    rows = files.withColumn("content_hash", _digest(content, path))
    sizes = rows.groupBy(F.col("content_hash").alias("of_hash")).agg(F.count("*").alias("group_size"), F.min(path).alias("first_path"))
    out = rows.join(sizes, F.col("content_hash") == F.col("of_hash")).drop("of_hash")
    return out.withColumn("is_duplicate", F.col(path) != F.col("first_path"))


def representatives(files: DataFrame, path: str, content: str) -> DataFrame:
    """The file with the least path of each content, with all its columns: what an expensive scan has to read."""
    first = files.groupBy(_digest(content, path).alias("hash_")).agg(F.min(path).alias("first_")).select(F.col("first_"))
    return files.join(first, F.col(path) == F.col("first_"), "left_semi")


def aggregate_hash(hashes: DataFrame, column: str) -> DataFrame:
    """aggregate_hash, n_files: one SHA-256 of a scan, whatever the order of its files: that of all sorted hashes joined.

    A SHA can't be joined from parts, so one task updates it; the hashes come to
    it sorted, in batches of a range-partitioned order, and it keeps the state
    alone, not the hashes.
    """
    ordered = hashes.select(F.col(column).alias("h")).where("h is not null").orderBy("h").coalesce(1)

    def update(batches):
        state, n = hashlib.sha256(), 0
        for batch in batches:
            state.update("".join(batch.column(0).to_pylist()).encode())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()]), pa.array([n], pa.int64())], names=["aggregate_hash", "n_files"])

    return ordered.mapInArrow(update, "aggregate_hash string, n_files long")


def hashes(files: DataFrame, content: str) -> DataFrame:
    """``files`` with md5, sha256 and sha512 of their content, in one projection."""
    data = F.col(content).cast("binary")
    return files.withColumns({"md5": F.md5(data), "sha256": F.sha2(data, 256), "sha512": F.sha2(data, 512)})


CACHE_DAYS = 30
CACHE_SECONDS = 1.0


def cache_lookup(files: DataFrame, cache: DataFrame, key: str, now: Column) -> DataFrame:
    """``files`` (key, size, mtime) with state: hit, invalid or not_found. cache: key, size, mtime, scanned_at.

    A result is valid for the same size, a time of change within a second, and 30 days.
    """
    known = cache.select(F.col(key).alias("c_key"), F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("scanned_at").alias("c_at"))
    valid = (F.abs(F.col("mtime") - F.col("c_mtime")) <= CACHE_SECONDS) & (F.col("size") == F.col("c_size")) & (now - F.col("c_at") <= CACHE_DAYS * 86400)
    state = F.when(F.col("c_key").isNull(), "not_found").when(valid, "hit").otherwise("invalid")
    return files.join(known, F.col(key) == F.col("c_key"), "left").withColumn("state", state).drop("c_key", "c_size", "c_mtime", "c_at")


def write_cache(results: DataFrame, path: str, key: str = "h") -> None:
    """Results by key under ``path``, in folders by the first two signs of the key; a folder that gets results keeps the newest of each key."""
    spark = results.sparkSession
    new = results.withColumn("prefix", F.substring(key, 1, 2))
    files = spark._jvm.org.apache.hadoop.fs
    place, staged = files.Path(path), f"{path}-staged-{uuid.uuid4().hex}"
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        new.write.partitionBy("prefix").parquet(path)
        return
    columns = [c for c in new.columns if c != key]
    old = spark.read.parquet(path).join(new.select("prefix").distinct(), "prefix", "left_semi").select(*new.columns)
    best = old.unionByName(new).groupBy(key).agg(F.max_by(F.struct(*columns), "scanned_at").alias("r"))
    # written beside first: what is replaced must not be read again if an executor is lost
    best.select(key, "r.*").select(*new.columns).write.parquet(staged)
    spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("prefix").parquet(path)
    store.delete(files.Path(staged), True)


def shard_groups(files: DataFrame) -> DataFrame:
    """dir, pattern, total_shards, total_size, first_shard of the parts of models. files: path, length."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    rows = files.select(folder.alias("dir"), K.shard(F.col("path")).alias("s"), "path", "length").where("s is not null")
    return rows.groupBy("dir", F.col("s.pattern").alias("pattern")).agg(F.count("*").alias("total_shards"), F.sum("length").alias("total_size"), F.min("path").alias("first_shard"))


def unlicensed(files: DataFrame, path: str, text: str) -> DataFrame:
    """Data files beside which no licence file stands and whose first ten lines name no licence."""
    folder, name = F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lower(K.file_name(F.col(path)))
    licensed = files.where(name.isin(*T.LICENSE_FILES)).select(folder.alias("of_dir")).distinct()
    data = files.where(K.extension(F.col(path)).isin(*T.DATA_EXTENSIONS) & (F.size(license_array(F.col(text), 10)) == 0))
    return data.join(licensed, folder == F.col("of_dir"), "left_anti")


def without_companion(files: DataFrame, every: DataFrame, path: str, companion: Column) -> DataFrame:
    """Files whose companion, a path made of their own, isn't there."""
    there = every.select(F.col(path).alias("there_")).distinct()
    return files.withColumn("companion_", companion).join(there, F.col("companion_") == F.col("there_"), "left_anti").drop("companion_")
