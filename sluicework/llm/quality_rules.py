"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space as one space) and hashed.
For each host (a column of the documents) the distinct documents that hold a
line are counted; documents of equal text are one. A line above the limit is
boilerplate and is removed from all of them but one, the one of the least text
key, so that a group of near copies keeps one whole member and no line is lost
to the corpus. A document of which too little is left is depleted and rejected.

At scale: one narrow Arrow pass turns each text into a light row (statistics
and 12 bytes a line), which is written once. Counting is two aggregations with
map-side partial results, so a line that a third of all rows hold arrives once
a text and task. Light lines are joined with the frequent ones by a 64-bit key
of (host, line), a hot line's rows dealt over tasks. ``quality_filter`` sends
each text through one equi-join by a 128-bit key, which AQE splits where a text
is hot.

Defined results. Null text: no words, all counts 0, base_failed. Empty text:
the same. Null host: a host of its own. A repeated row is judged like the row
it repeats; ties in the least key are equal texts, which share a verdict. Very
long texts are judged whole. An empty table gives an empty result. A column in
``keep`` that is named like an output gets underscores before its name; extra
columns pass through ``quality_filter``, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, spread_join, stored, table, text_key
from .textvec import EXACT, FOLDED, Runs, Texts, U, blocks, mix

#: Production parameters.
LINE_LIMIT = 20  # a line that more distinct documents of one host hold is boilerplate
MIN_KEPT_SHARE = 0.2  # a document that lost lines is depleted if less than this share of its words is left
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
BLOCK_BYTES = 1 << 18

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
LIGHT = f"{STATS}, lines array<long>, line_words array<int>"


def _repeated(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: whether it is there twice or more, and whether it is a later one of equals."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    again, many = np.zeros(len(values), bool), np.zeros(len(values), bool)
    again[order[1:][same]] = True
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    return many, again


def _sums(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, n).astype(np.int64)


def statistics(column: pa.Array) -> list[pa.Array]:
    """The columns of LIGHT for one batch of texts."""
    t = Texts(column)
    n, words = t.n, len(t.start)
    by_doc = mix(np.arange(1, n + 1, dtype=U))
    exact = Runs(t.word_hashes(EXACT))
    folded = Runs(t.word_hashes(FOLDED))
    # words in 5-word windows that the text has twice
    w = t.windows(5)
    covered = np.zeros(words + 1, np.int64)
    if len(w):
        window = exact.hash(w, w + 5)
        many, _ = _repeated(window ^ by_doc[t.doc[w]])
        np.add.at(covered, w[many], 1)
        np.add.at(covered, w[many] + 5, -1)
    repeat_words = _sums(t.doc, n, np.cumsum(covered[:-1]) > 0)
    # lines
    stops = np.flatnonzero(t.bytes == 10)
    end = np.concatenate((t.at[1:], stops))  # a document's last line ends with it; its end comes before a \n that follows it
    order = np.argsort(end, kind="stable")
    end, is_doc_end = end[order], order < n
    begin = np.concatenate((t.at[:1], end[:-1] + ~is_doc_end[:-1]))[: len(end)]  # a line starts after its \n
    line_doc = np.concatenate(([0], np.cumsum(is_doc_end)[:-1]))[: len(end)]
    a, b = np.searchsorted(t.start, begin), np.searchsorted(t.start, end)
    full = b > a
    begin, end, line_doc, a, b = begin[full], end[full], line_doc[full], a[full], b[full]
    raw = Runs(EXACT[t.bytes]).hash(begin, end)
    _, again = _repeated(raw ^ by_doc[line_doc])
    normal = folded.hash(a, b)
    line_at = np.searchsorted(line_doc, np.arange(n + 1)).astype(np.int32)
    utf8 = t.inside & ((t.bytes & 0xC0) != 0x80)
    return [
        pa.array(t.count.astype(np.int64)),
        pa.array(t.per_doc(utf8)),
        pa.array(t.per_doc(_SYMBOL[t.bytes])),
        pa.array(_sums(line_doc, n, again)),
        pa.array(repeat_words),
        pa.ListArray.from_arrays(pa.array(line_at), pa.array(normal.astype(np.int64))),
        pa.ListArray.from_arrays(pa.array(line_at), pa.array((b - a).astype(np.int32))),
    ]


_NAMES = [x.split()[0] for x in LIGHT.split(", ")]


def light(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One light row for each document: the columns ``keep``, then those of LIGHT."""
    fields = docs.select(*keep).schema

    def run(batches):
        for block in blocks(batches, BLOCK_BYTES, "text"):
            rest = [block.column(i) for i in range(1, block.num_columns)]
            stats = statistics(block.column(0))
            yield pa.RecordBatch.from_arrays([*rest, *stats], names=[*[f"c{i}" for i in range(len(keep))], *_NAMES])

    renamed = docs.select(F.col(text).alias("text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields)), LIGHT])
    return renamed.mapInArrow(run, schema).toDF(*keep, *_NAMES)


def frequent_lines(lines: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """line_key, n, first1, first2: the lines that more than ``limit`` distinct texts hold, and the least key of these. lines: line_key, k1, k2."""
    found = lines.distinct().groupBy("line_key").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2")).alias("first"))
    return found.where(F.col("n") > limit).select("line_key", "n", F.col("first.k1").alias("first1"), F.col("first.k2").alias("first2"))


def _judged(docs: DataFrame, limit: int) -> DataFrame:
    """``docs`` (c0 .. cn, host, text, k1, k2) without the text, with statistics, verdict and gone: the places of removed lines among the lines with a word."""
    own = [c for c in docs.columns if c != "text"]
    rows = stored(light(docs, own).withColumn("row_number", F.monotonically_increasing_id()))
    line = F.struct(F.xxhash64("host", "l.lines").alias("line_key"), F.col("l.line_words").alias("words"))
    each = rows.select("row_number", "k1", "k2", "host", F.posexplode(F.arrays_zip("lines", "line_words")).alias("place", "l"))
    each = each.select("row_number", "k1", "k2", "place", line.alias("s")).select("row_number", "k1", "k2", "place", "s.*")
    often = stored(frequent_lines(each.select("line_key", "k1", "k2"), limit))
    hits = spread_join(each, often, "line_key").where((F.col("k1") != F.col("first1")) | (F.col("k2") != F.col("first2")))
    hits = hits.groupBy(F.col("row_number").alias("hit_row")).agg(F.collect_list("place").alias("gone"), F.sum("words").alias("n_removed_words"))
    out = rows.join(hits, F.col("row_number") == F.col("hit_row"), "left").drop("hit_row", "row_number", "lines", "line_words")
    out = out.withColumns({"n_removed_words": F.coalesce("n_removed_words", F.lit(0)), "gone": F.coalesce("gone", F.array().cast("array<int>"))})
    out = out.withColumn("n_removed_lines", F.size("gone").cast("long"))
    left = F.col("n_words") - F.col("n_removed_words")
    out = out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "depleted": (F.col("n_removed_words") > 0) & (left < MIN_KEPT_SHARE * F.col("n_words")),
        }
    )
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


_VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_lines", "n_removed_words", "base_failed", "depleted", "kept"]


def judge(docs: DataFrame, keep: list[str], host: str = "source", text: str = "text", limit: int = LINE_LIMIT) -> DataFrame:
    """The columns ``keep`` of every document with its statistics and verdict.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_removed_lines, n_removed_words, base_failed, depleted, kept.
    """
    names = [f"c{i}" for i in range(len(keep))]
    key = text_key(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(host).alias("host"), F.col(text).alias("text"), *key)
    return _judged(rows, limit).select(*names, *_VERDICT).toDF(*kept(keep, _VERDICT), *_VERDICT)


def without_lines(text: str, gone: list[int]) -> str:
    """The text without the lines at these places among its lines with a word."""
    drop, out, place = set(gone), [], 0
    for line in text.split("\n"):
        blank = not line.strip(" \t\n\v\f\r")
        if blank or place not in drop:
            out.append(line)
        place += not blank
    return "\n".join(out)


def quality_filter(docs: DataFrame, host: str = "source", text: str = "text", length: str | None = "n_chars", limit: int = LINE_LIMIT) -> DataFrame:
    """The documents that the rules keep, with all their columns, without their boilerplate lines; ``length`` becomes the new length.

    The verdict depends on text and host alone, so it is found once for each
    key of (text, host). Texts that lose no line stay byte for byte.
    """
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = {c: k for k, c in names.items()}
    rows = docs.toDF(*names).select("*", *text_key(F.coalesce(F.col(own[text]), F.lit(""))))
    found = _judged(rows.select(F.col(own[host]).alias("host"), F.col(own[text]).alias("text"), "k1", "k2"), limit)
    changed = found.where(~F.col("kept") | (F.col("n_removed_lines") > 0)).groupBy("host", "k1", "k2").agg(F.first("kept").alias("stays"), F.first("gone").alias("gone"))
    changed = changed.withColumnsRenamed({"host": "of_host", "k1": "of1", "k2": "of2"})
    match = (F.col("k1") == F.col("of1")) & (F.col("k2") == F.col("of2")) & F.col(own[host]).eqNullSafe(F.col("of_host"))
    out = rows.join(changed, match, "left").where(F.coalesce("stays", F.lit(True))).select(*names, F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))

    def run(batches):
        for batch in blocks(batches, BLOCK_BYTES, own[text]):
            place = batch.schema.get_field_index(own[text])
            many = np.asarray(pc.list_value_length(batch.column(len(names))))
            columns = batch.columns[: len(names)]
            if many.any():
                old, gone = columns[place].to_pylist(), batch.column(len(names))
                for i in np.flatnonzero(many):
                    old[i] = without_lines(old[i], gone[int(i)].as_py())
                columns[place] = pa.array(old, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, names=list(names))

    schema = ", ".join(f"{k} {out.schema[k].dataType.simpleString()}" for k in names)
    whole = out.mapInArrow(run, schema).toDF(*docs.columns)
    if length in docs.columns:
        whole = whole.withColumn(length, F.when(F.col(text).isNotNull(), F.length(text)).otherwise(F.col(length)).cast(docs.schema[length].dataType))
    return whole


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), ["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "n_removed_words")
