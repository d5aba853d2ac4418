"""Ordered rows: opcode patterns, streams, stack depth, look-ahead, runs, offsets."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def suffix_matches(ops: DataFrame, patterns: Sequence[tuple[str, Sequence[str]]], key: str, order: str, name: str) -> DataFrame:
    """key, order, pattern: where the last opcodes up to a row are a pattern."""
    longest = max(len(p) for _, p in patterns)
    window = F.collect_list(name).over(_by(key, order).rowsBetween(1 - longest, 0))
    rows = ops.select(key, order, window.alias("last"))
    hit = [F.when(F.slice("last", -len(p), len(p)) == F.array(*[F.lit(x) for x in p]), F.lit(n)) for n, p in patterns]
    hit = [F.when(F.size("last") >= len(p), h) for h, (_, p) in zip(hit, patterns, strict=True)]
    return rows.select(key, order, F.explode(F.array_compact(F.array(*hit))).alias("pattern"))


def stream_ids(ops: DataFrame, key: str, order: str, name: str, stop: str) -> DataFrame:
    """Adds stream: how many stops came before."""
    before = _by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return ops.withColumn("stream", F.coalesce(F.sum((F.col(name) == stop).cast("long")).over(before), F.lit(0)))


def final_depth(ops: DataFrame, key: str, order: str, change: Column, reset: Column) -> DataFrame:
    """key, depth, deepest: a counter that never falls below 0 and is 0 again at a reset. ``change``: what a row adds.

    The floor makes it no plain sum: within a stretch between resets the depth
    is the running sum less its least value so far, or 0.
    """
    up_to = _by(key, order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ops.withColumn("stretch_", F.sum(reset.cast("long")).over(up_to)).withColumn("change_", F.when(reset, 0).otherwise(change))
    within = Window.partitionBy(key, "stretch_").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("sum_", F.sum("change_").over(within))
    rows = rows.withColumn("depth_", F.col("sum_") - F.least(F.lit(0), F.min("sum_").over(within)))
    return rows.groupBy(key).agg(F.max_by("depth_", order).alias("depth"), F.max("depth_").alias("deepest"))


def last_strings(ops: DataFrame, key: str, order: str, said: str, at: Column) -> DataFrame:
    """key, order, module, function: the last two strings before each row of ``at``."""
    before = _by(key, order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ops.withColumn("last_", F.last(said, ignorenulls=True).over(before))
    second = F.when(F.col(said).isNotNull(), F.struct(F.col("last_").alias("before"), F.col(said).alias("own")))
    rows = rows.withColumn("pair_", F.last(second, ignorenulls=True).over(before))
    return rows.where(at).select(key, order, F.col("pair_.before").alias("module"), F.col("pair_.own").alias("function"))


def neighbours(rows: DataFrame, key: str, order: str, text: str, n: int) -> DataFrame:
    """key, order, near: a row's text with those of ``n`` rows before and after."""
    return rows.select(key, order, F.array_join(F.collect_list(text).over(_by(key, order).rowsBetween(-n, n)), " ").alias("near"))


def followed(ops: DataFrame, key: str, order: str, first: Column, then: Column, reach: int = 5) -> DataFrame:
    """key, at: the first row of each key after which, within ``reach`` rows, another one follows."""
    ahead = F.max(then.cast("int")).over(_by(key, order).rowsBetween(1, reach))
    return ops.withColumn("ahead_", ahead).where(first & (F.col("ahead_") == 1)).groupBy(key).agg(F.min(order).alias("at"))


def runs(ops: DataFrame, key: str, order: str, name: str, least: int) -> DataFrame:
    """key, name, start, length of the runs of equal opcodes that are at least so long."""
    all_, same = _by(key, order), Window.partitionBy(key, name).orderBy(order)
    island = F.row_number().over(all_) - F.row_number().over(same)
    out = ops.withColumn("island_", island).groupBy(key, name, "island_").agg(F.min(order).alias("start"), F.count("*").alias("length"))
    return out.where(F.col("length") >= least).drop("island_")


def alerts(ops: DataFrame, key: str, order: str, dangerous: Column, threshold: int) -> DataFrame:
    """key, order: where a count of dangerous opcodes passes the threshold and starts again at 0."""
    count = F.sum(dangerous.cast("long")).over(_by(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return ops.withColumn("count_", count).where(dangerous & (F.col("count_") % (threshold + 1) == 0)).select(key, order)


def gaps(tensors: DataFrame, key: str, begin: str, end: str) -> DataFrame:
    """key, begin, expected: where a tensor doesn't start where the one before ended."""
    expected = F.lag(end, 1, 0).over(_by(key, begin))
    return tensors.select(key, F.col(begin).alias("begin"), expected.cast("long").alias("expected")).where("begin <> expected")


def offset_order(tensors: DataFrame, key: str, order: str, size: Column) -> DataFrame:
    """key, order, problem: tensors whose offsets fall ("order") or leave more or less room than ``size`` and the alignment ("size"). tensors: offset, data_start, alignment, length."""
    following = F.lead("offset").over(_by(key, order))
    end = F.coalesce(following, F.col("length") - F.col("data_start"))
    problem = F.when(following < F.col("offset"), "order").when(F.abs(size - (end - F.col("offset"))) > F.col("alignment"), "size")
    return tensors.withColumn("problem", problem).where("problem is not null").select(key, order, "problem")


def throttled(events: DataFrame, key: str, at: str, interval: float) -> DataFrame:
    """key, emitted: how many events pass if each must be ``interval`` after the last that passed.

    Whether an event passes hangs on all before it, so a key is folded in order:
    its times stream sorted through one task, which keeps the last that passed
    and nothing else.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("k"), F.col(at).cast("double").alias("t")).repartition("k").sortWithinPartitions("k", "t")

    def fold(batches):
        now, last, n = None, None, 0
        for batch in batches:
            done = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if n and k != now:
                    done.append((now, n))
                    n = 0
                if not n or t - last >= interval:
                    last, n = t, n + 1
                now = k
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.schema.field(0).type), pa.array([m for _, m in done], pa.int64())], names=["k", "emitted"])
            field = batch.schema.field(0).type
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([now], field), pa.array([n], pa.int64())], names=["k", "emitted"])

    return rows.mapInArrow(fold, f"k {kind}, emitted long").withColumnRenamed("k", key)
