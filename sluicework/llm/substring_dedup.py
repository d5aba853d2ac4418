"""Substring dedup by seed and extend.

Seeds. Of each run of 28 neighbouring 8-word grams the one of the least hash
is an anchor (winnowing), so every window of 35 words holds one, and equal
windows choose equal anchors. Anchors that occur once can't be part of a
repeat and are dropped by an aggregation on the anchor's hash.

Extend. Around a repeated anchor stand the windows that chose it. Occurrences
whose whole stretch (all these windows, both ways) is equal form a class; a
class of two or more is a repeat in full. Only the stretches of classes of one,
which are the edges of repeats, are extended window by window: they and one
representative of every other class of the anchor give their windows' hashes,
and a window that is alone among them is unique. All other windows of repeated
anchors are repeats; neighbouring ones merge into maximal repeats.

So no pairs are made: a group of g copies gives one class row for each anchor,
after a map-side partial aggregation, and the work is linear in the text.
Equality is that of two 64-bit hashes: of the anchor, and of the stretch or
window, which has another table of bytes and another base.

An anchor that very many places hold, or that has very many classes, is found
by its count, and its rows are dealt over tasks (``spread_join``).

Documents are joined by a 128-bit key of the text, never by a row number, so
that any recomputed task gives the same rows. Copies of one text share all
decisions. The text is shuffled once for each of two equi-joins, which AQE
splits where a text is hot.

Defined results. Null text: no words, kept_sha256 of the empty string. Texts
under the window's length keep all words. Ties and repeated rows: every copy
loses the words. Empty table: empty result. Extra columns pass through
``remove_repeats`` whatever their names; a column in ``keep`` that is named like
an output gets underscores before its name. Very long texts are taken whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, spread_join, stored, table, text_key
from .textvec import EXACT, SECOND, SECOND_STEP, Runs, Texts, U, blocks, sliding_min

WINDOW = 35  # words
GRAM = 8  # words of an anchor
BLOCK_BYTES = 1 << 18


def second(t: Texts) -> Runs:
    """Hashes of the second family."""
    return Runs(t.word_hashes(SECOND, SECOND_STEP), SECOND_STEP)


def anchors(t: Texts, runs: Runs, other: Runs, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """hash, whole-stretch hash, first window's word, number of windows, document: for each anchor of a block.

    The order is that of the hashes' upper bits, then that of the places, so
    equal windows have their anchor at the same word, and equal windows of one
    periodic text have different anchors of one hash.
    """
    n, width = len(t.start), window - gram + 1
    if n < window:
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    at = np.arange(n - gram + 1)
    grams = runs.hash(at, at + gram)
    place = U((1 << 28) - 1)  # no Arrow text has more words
    least = sliding_min((grams & ~place) | at.astype(U), width)
    here = np.arange(n - window + 1)
    spot = (least & place).astype(np.int64)
    valid = t.doc[: n - window + 1] == t.doc[window - 1 :]
    here, spot = here[valid], spot[valid]
    if not len(here):
        return (np.zeros(0, U), np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
    new = np.append(True, (spot[1:] != spot[:-1]) | (here[1:] != here[:-1] + 1))
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(here)))
    a, spot = here[begin], spot[begin]
    stretch = other.hash(a, a + count + window - 1) + (spot - a).astype(U) * U(0x9FB21C651E98DF25)
    return grams[spot], stretch, a, count, t.doc[a]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int64) if x.dtype != U else x.view(np.int64))


def seeds(keyed: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, stretch, k1, k2, at: every anchor of every text. ``at`` holds the first window's word and the number of windows."""

    def run(batches):
        for block in blocks(batches, BLOCK_BYTES):
            t = Texts(block.column(0))
            anchor, stretch, a, count, doc = anchors(t, Runs(t.word_hashes(EXACT)), second(t), window, gram)
            at = (a - t.first[doc]) * 64 + count
            k1, k2 = (block.column(i).take(pa.array(doc)) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(stretch), k1, k2, _signed(at)], names=["anchor", "stretch", "k1", "k2", "at"])

    return keyed.select("text", "k1", "k2").where(F.col("text").isNotNull()).mapInArrow(run, "anchor long, stretch long, k1 long, k2 long, at long")


def _ranges(encoded: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words are covered. Numbers 64 * a + n add n windows from word a on; 64 * a + 0 take the window at a out again."""
    windows = np.zeros(n_words + 1, np.int64)
    a, n = encoded >> 6, encoded & 63
    np.add.at(windows, a[n > 0], 1)
    np.add.at(windows, (a + n)[n > 0], -1)
    marked = np.cumsum(windows) > 0
    marked[a[n == 0]] = False
    starts = np.flatnonzero(marked)
    cover = np.zeros(n_words + window + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return np.cumsum(cover)[:n_words] > 0


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of an array column; a null is empty."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    return np.concatenate(([0], np.cumsum(sizes))), np.asarray(column.flatten())


def repeats(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """r1, r2, ranges: for each key of a text with repeats, what ``_ranges`` reads. ``keyed`` has text, k1, k2 and other columns."""
    found = seeds(keyed, window, gram)
    often = stored(found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1"))
    found = stored(spread_join(found, often, "anchor").drop("n"))
    classes = found.groupBy("anchor", "stretch").agg(F.count("*").alias("n"), *(F.min_by(c, F.struct("k1", "k2", "at")).alias(c) for c in ("k1", "k2", "at")))
    classes = stored(classes)
    mixed = classes.groupBy("anchor").agg(F.min("n").alias("least"), F.count("*").alias("n")).where("n > 1 and least = 1")
    edges = spread_join(classes.withColumnRenamed("n", "places"), stored(mixed), "anchor")
    edges = edges.groupBy(F.col("k1").alias("e1"), F.col("k2").alias("e2")).agg(F.collect_list(F.struct("anchor", "at", F.col("places").alias("n"))).alias("edges"))

    def extend(batches):
        for block in blocks(batches, BLOCK_BYTES):
            t = Texts(block.column(block.schema.get_field_index("text")))
            runs = second(t)
            offsets, _ = _lists(edge := block.column(block.schema.get_field_index("edges")))
            anchor, at, n = (np.asarray(x) for x in edge.flatten().flatten())
            doc = np.repeat(np.arange(t.n), np.diff(offsets))
            count = at & 63
            each = np.repeat(np.arange(len(at)), count)
            step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            start = t.first[doc[each]] + (at >> 6)[each] + step
            k1, k2 = (block.column(block.schema.get_field_index(k)).take(pa.array(doc[each])) for k in ("k1", "k2"))
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor[each]), _signed(runs.hash(start, start + window)), _signed(n[each]), k1, k2, _signed(((at >> 6)[each] + step) * 64)],
                names=["anchor", "hash", "n", "k1", "k2", "at"],
            )

    windows = keyed.join(edges, (F.col("k1") == F.col("e1")) & (F.col("k2") == F.col("e2"))).mapInArrow(extend, "anchor long, hash long, n long, k1 long, k2 long, at long")
    alone = windows.groupBy("anchor", "hash").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("k1", "k2", "at"))).where("n = 1")
    every = found.select("k1", "k2", "at").unionByName(alone.select("k1", "k2", "at"))
    return every.groupBy(F.col("k1").alias("r1"), F.col("k2").alias("r2")).agg(F.collect_set("at").alias("ranges"))


def _with_ranges(docs: DataFrame, text: str, window: int, gram: int) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` under safe names (text is "text") and their repeats; the names that were."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = next(k for k, c in names.items() if c == text)
    safe = docs.toDF(*names).withColumnRenamed(own, "text")
    keyed = safe.withColumns(dict(zip(("k1", "k2"), (F.coalesce(k, F.lit(0)) for k in text_key(F.col("text"))), strict=True)))
    found = repeats(keyed, window, gram)
    names = {"text" if k == own else k: c for k, c in names.items()}
    return keyed.join(found, (keyed.k1 == found.r1) & (keyed.k2 == found.r2), "left"), names


def _kept_words(block: pa.RecordBatch, window: int):
    """For each row: number of words, number removed, the kept words joined by one space as bytes."""
    offsets, values = _lists(block.column(block.schema.get_field_index("ranges")))
    for i, text in enumerate(block.column(block.schema.get_field_index("text")).cast(pa.binary())):
        words = (text.as_py() or b"").split()
        if offsets[i] == offsets[i + 1]:
            yield len(words), 0, b" ".join(words)
            continue
        gone = _ranges(values[offsets[i] : offsets[i + 1]], len(words), window)
        yield len(words), int(gone.sum()), b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])


_REPORT = ["n_words", "n_removed", "kept_sha256"]


def dedup_report(docs: DataFrame, keep: list[str], text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The columns ``keep`` of each document with n_words, n_removed and the kept words' SHA-256."""
    own = [f"k_{i}" for i in range(len(keep))]
    joined, names = _with_ranges(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], F.col(text).alias("text")), "text", window, gram)
    place = {c: k for k, c in names.items()}

    def run(batches):
        for block in blocks(batches, BLOCK_BYTES):
            n, gone, digest = zip(*((n, gone, hashlib.sha256(words).hexdigest()) for n, gone, words in _kept_words(block, window)), strict=True)
            columns = [block.column(block.schema.get_field_index(place[k])) for k in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest)], names=[*own, *_REPORT])

    schema = ", ".join(f"{k} {joined.schema[place[k]].dataType.simpleString()}" for k in own)
    return joined.mapInArrow(run, f"{schema}, n_words long, n_removed long, kept_sha256 string").toDF(*kept(keep, _REPORT), *_REPORT)


def remove_repeats(docs: DataFrame, text: str = "text", length: str | None = "n_chars", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """All documents and columns; a text with repeats becomes its kept words joined by one space, and ``length`` its new length.

    A text without repeats stays byte for byte; a null stays null.
    """
    joined, names = _with_ranges(docs, text, window, gram)

    def run(batches):
        for block in blocks(batches, BLOCK_BYTES):
            place = block.schema.get_field_index("text")
            old = block.column(place)
            new = [words if gone else None for _, gone, words in _kept_words(block, window)]
            column = pa.array([o.as_py() if n is None else n.decode() for o, n in zip(old, new, strict=True)], old.type)
            columns = [column if i == place else block.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    back = joined.select(*names, "ranges")
    schema = ", ".join(f"{k} {joined.schema[k].dataType.simpleString()}" for k in names)
    out = back.mapInArrow(run, schema).toDF(*names.values())
    if length in docs.columns:
        out = out.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_report(table(spark, sf_dir, "documents"), ["doc_id"])


_LAST = WINDOW - 1
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, s, array_to_string(w[s:s + {_LAST}], ' ') AS p FROM (SELECT r, w, unnest(range(1, len(w) - {_LAST} + 1)) AS s FROM d WHERE len(w) >= {WINDOW})),
c AS (SELECT p FROM x GROUP BY p HAVING count(*) > 1),
h AS (SELECT DISTINCT r, unnest(range(s, s + {WINDOW})) AS k FROM x JOIN c USING (p)),
e AS (SELECT r, k, w[k] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS k FROM d)),
o AS (SELECT e.r, string_agg(word, ' ' ORDER BY e.k) AS t, count(*) AS n FROM e LEFT JOIN h ON e.r = h.r AND e.k = h.k WHERE h.r IS NULL GROUP BY e.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN o USING (r)
"""
