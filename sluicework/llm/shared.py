"""What the operators of this subpackage share: keys of texts, tables in the shared folder, batch mapping."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir.

    Where it is unset, a local session (one machine, as in tests) gets a folder
    of its own, which goes when the process ends; a cluster is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _own_folder()


@lru_cache(maxsize=1)
def _own_folder() -> str:
    folder = tempfile.mkdtemp(prefix="sluicework-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return f"file://{folder}"


#: Folders that write() made since the innermost scratch() began.
_scratch: list[list[str]] = []


def write(df: DataFrame, lasting: bool = False) -> str:
    """The folder in which ``df`` now stands as Parquet; a lasting one outlives the scratch() around."""
    path = f"{shared_folder(df.sparkSession)}/sluicework-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scratch and not lasting:
        _scratch[-1].append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage is cut and a lost executor costs nothing.

    The folder lives until the scratch() around ends, or as long as the session's checkpoints do.
    """
    return df.sparkSession.read.schema(df.schema).parquet(write(df))


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder that write() made."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """What is written within is deleted at the end; results must have been written by then."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            discard(spark, path)


HOT_SHARE = 1000
HOT_ROWS = 256
SALTS = 64


def hot_keys(counted: DataFrame, key: str, total: int) -> list[int]:
    """Keys that hold more than a thousandth of all rows: fewer than HOT_SHARE, whatever the data. counted: key, n."""
    return [r[0] for r in counted.where(F.col("n") > max(total // HOT_SHARE, HOT_ROWS)).select(key).collect()]


def spread_join(rows: DataFrame, counted: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``counted`` that have their key, those without one left out.

    counted: one row a key, with n, the number of rows that have it. The rows of
    a hot key are dealt over SALTS tasks and its one row is copied to each.
    """
    if total is None:
        total = counted.agg(F.sum("n")).first()[0] or 0
    hot = hot_keys(counted, key, total)
    if not hot:
        return rows.join(counted, key)
    of = F.col(key).isin(*hot)
    salt = F.when(of, F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.explode(F.when(of, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("salt_", salt).join(counted.withColumn("salt_", copies), [key, "salt_"]).drop("salt_")


SMALL_KEYS = 1 << 20


def semi_join(rows: DataFrame, keys: DataFrame, condition: Column) -> DataFrame:
    """Rows whose key is in ``keys`` (stored, a few numbers a row), which are broadcast if they are counted to be few."""
    return rows.join(F.broadcast(keys) if keys.count() <= SMALL_KEYS else keys, condition, "left_semi")


def text_key(text: Column) -> list[Column]:
    """k1, k2: 128 bits that stand for a text; both null for a null text."""
    digest = F.md5(text)
    half = lambda i: F.conv(F.substring(digest, i, 16), 16, -10).cast("long")
    return [half(1).alias("k1"), half(17).alias("k2")]


def fresh(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of the caller has it (Spark does not tell case apart)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name


def kept(keep: list[str], outputs: list[str]) -> list[str]:
    """Names under which the columns ``keep`` come out: their own, lengthened by fresh() where an output has it."""
    names: list[str] = []
    for c in keep:
        names.append(fresh(c, [*outputs, *names]))
    return names
