"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark's items: ten consecutive words, or
all words of a shorter item. For each pattern length there are a shift table
(for each block of two words, how far the search may move on), buckets of
patterns by their last block, and a direct comparison of all words. A word of
no item at the end of the search window moves the search by almost a whole
pattern.

A pattern is a place in the items' word numbers, kept once however many items
have it, so the tables take some 30 times the items' text. Their size is
checked: the items are measured first. Up to ``TABLE_BYTES`` of text, one table
is broadcast and the search is one narrow pass without a shuffle. Beyond that
the items are dealt into blocks below the limit, which are searched one after
another, each in a pass of its own whose table is freed before the next is
built. Such a pass writes the hits alone, by a 128-bit key of the text; they are
gathered by that key, where equal texts are one, and joined with the documents.
Nothing is dropped, and at any time one block is in memory.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased.

Defined results. Null or empty text: no words, clean. Null or empty item: no
windows. Items with equal texts are each found; a repeated item_id counts once;
a null item_id is written as the empty string. Empty tables give empty or clean
results. Repeated rows are judged each. Very long texts are searched whole. Extra
columns pass through ``remove_contaminated`` whatever their names; a column in
``keep`` that is named like an output gets underscores before its name.
"""

from __future__ import annotations

from array import array
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import kept, stored, table, text_key, write
from .textvec import blocks

WINDOW = 10
TABLE_BYTES = 2 << 20
BLOCK_BYTES = 1 << 20
_FOLD = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 128 else c + 32 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class WuManber:
    """Patterns of one length: places in ``flat``, the word numbers of all items one after another."""

    def __init__(self, length: int, flat: array, places: dict[bytes, list[int]], owner: array):
        self.length, self.block, self.flat, self.owner = length, min(2, length), flat, owner
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, list[int]] = {}
        self.more: dict[int, list[int]] = {}  # other items that have the pattern
        for many in places.values():
            first = many[0]
            if len(many) > 1:
                self.more[first] = sorted({owner[p] for p in many} - {owner[first]})
            for end in range(first + self.block, first + length + 1):
                block = self._block(flat, end)
                self.shift[block] = min(self.shift.get(block, self.far), first + length - end)
            self.bucket.setdefault(self._block(flat, first + length), []).append(first)

    def _block(self, text: array, end: int) -> int:
        return text[end - 1] if self.block == 1 else text[end - 2] << 32 | text[end - 1]

    def search(self, text: array, hit: bytearray, found: set[int]) -> None:
        n, length, far, shift, bucket, flat = len(text), self.length, self.far, self.shift, self.bucket, self.flat
        two, end = self.block == 2, length
        while end <= n:
            last = text[end - 1]
            if not last:  # a word of no item
                end += length
                continue
            block = text[end - 2] << 32 | last if two else last
            move = shift.get(block, far)
            if move:
                end += move
                continue
            start = end - length
            window = text[start:end]
            for place in bucket[block]:
                if flat[place : place + length] == window:
                    hit[start:end] = b"\1" * length
                    found.add(self.owner[place])
                    found.update(self.more.get(place, ()))
                    break
            end += 1


class Search:
    """All patterns of some items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.names = sorted({item for item, _ in items})
        name = {x: i for i, x in enumerate(self.names)}
        self.number: dict[bytes, int] = {}
        flat, owner = array("I"), array("I")
        by_length: dict[int, dict[bytes, list[int]]] = defaultdict(dict)
        for item, text in items:
            numbers = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            size, base = min(window, len(numbers)), len(flat)
            flat.extend(numbers)
            owner.extend([name[item]] * len(numbers))
            for place in range(base, base + len(numbers) - size + 1 if size else base):
                by_length[size].setdefault(flat[place : place + size].tobytes(), []).append(place)
        self.parts = [WuManber(size, flat, places, owner) for size, places in sorted(by_length.items())]

    def search(self, text: list[bytes], hit: bytearray) -> list[str]:
        """Marks the words that occurrences cover; the items found, as sorted strings."""
        get = self.number.get
        numbers = array("I", [get(w, 0) for w in text])
        found: set[int] = set()
        for part in self.parts:
            part.search(numbers, hit, found)
        return [self.names[i] for i in sorted(found)]


def _items(benchmark: DataFrame, item_id: str, text: str, table_bytes: int) -> list[DataFrame]:
    """The items in blocks below ``table_bytes`` of text on the average of their hash. One item is never split, so its windows stay whole."""
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    if size <= table_bytes:
        return [rows]
    n = -(-2 * size // table_bytes)
    rows = stored(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))).repartition("block").sortWithinPartitions("block"))
    return [rows.where(F.col("block") == i).drop("block") for i in range(n)]  # sorted files, so a block reads its row groups


def _searched(table: Search, texts: pa.Array) -> list[tuple[int, bytes, list[str]]]:
    """n_words, hit_words, items of each text."""
    out = []
    for value in texts.cast(pa.binary()):
        w = words(value.as_py())
        hit = bytearray(len(w))
        items = table.search(w, hit)
        out.append((len(w), bytes(hit), items))
    return out


_FOUND = "n_words long, n_hit long, hit_words binary, items array<string>"


def _columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.string()))
    return [pa.array(x, kind) for x, kind in zip(zip(*((n, sum(hit), hit, items) for n, hit, items in rows), strict=True), kinds, strict=True)]


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, table_bytes: int = TABLE_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """All columns of ``docs`` under safe names (c0, c1, ...; second result: the names that were) with n_words, n_hit, hit_words, items.

    hit_words: one byte a word, 1 for a word that an occurrence covers.
    items: the ids of the items found, as sorted strings.
    """
    spark, parts = docs.sparkSession, _items(benchmark, item_id, item_text, table_bytes)
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = next(k for k, c in names.items() if c == text)
    safe = docs.toDF(*names)
    found_names = [x.split()[0] for x in _FOUND.split(", ")]

    def table_of(part: DataFrame):
        return spark.sparkContext.broadcast(Search([(r.item, r.text.encode()) for r in part.toLocalIterator()], window))

    if len(parts) == 1:
        shared = table_of(parts[0])

        def run(batches):
            table = shared.value
            for block in blocks(batches, BLOCK_BYTES, own):
                rows = _searched(table, block.column(block.schema.get_field_index(own)))
                yield pa.RecordBatch.from_arrays([*block.columns, *_columns(rows)], names=[*names, *found_names])

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema)
        return safe.mapInArrow(run, f"{schema}, {_FOUND}"), names

    folders = []
    keyed = safe.select(F.col(own).alias("text"), *text_key(F.col(own))).where("text is not null")
    for number, part in enumerate(parts):
        shared = table_of(part)

        def hits(batches, shared=shared, number=number):
            table = shared.value
            for block in blocks(batches, BLOCK_BYTES):
                rows = _searched(table, block.column(0))
                at = [i for i, r in enumerate(rows) if r[2]]
                if at:
                    k1, k2 = (block.column(i).take(pa.array(at)) for i in (1, 2))
                    hit, items = (pa.array([rows[i][j] for i in at], kind) for j, kind in ((1, pa.binary()), (2, pa.list_(pa.string()))))
                    yield pa.RecordBatch.from_arrays([k1, k2, pa.array([number] * len(at), pa.int32()), hit, items], names=["k1", "k2", "block", "hit", "items"])

        folders.append(write(keyed.mapInArrow(hits, "k1 long, k2 long, block int, hit binary, items array<string>")))
        shared.destroy()
    each = spark.read.schema("k1 long, k2 long, block int, hit binary, items array<string>").parquet(*folders)
    one = each.groupBy("k1", "k2", "block").agg(F.first("hit").alias("hit"), F.first("items").alias("items"))  # copies of a text have equal hits
    gathered = one.groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(F.collect_list("hit").alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("all_items"))
    both = safe.withColumns(dict(zip(("k1", "k2"), text_key(F.col(own)), strict=True)))
    both = both.join(gathered, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left").select(*names, "hits", "all_items")

    def merge(batches):
        for block in blocks(batches, BLOCK_BYTES, own):
            rows = []
            for value, hits, items in zip(block.column(block.schema.get_field_index(own)).cast(pa.binary()), *block.columns[-2:], strict=True):
                n = len(words(value.as_py()))
                hit = 0
                for h in hits.as_py() or ():
                    hit |= int.from_bytes(h, "little")
                rows.append((n, hit.to_bytes(n, "little"), items.as_py() or []))
            yield pa.RecordBatch.from_arrays([*block.columns[:-2], *_columns(rows)], names=[*names, *found_names])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in safe.schema)
    return both.mapInArrow(merge, f"{schema}, {_FOUND}"), names


_REPORT = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", **options) -> DataFrame:
    """The columns ``keep`` with n_words, n_hit, n_items, items_sha256, contaminated."""
    own = [f"k_{i}" for i in range(len(keep))]
    found, names = find(docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)], F.col(text).alias("text")), benchmark, **options)
    place = {c: k for k, c in names.items()}
    return found.select(
        *[F.col(place[k]).alias(c) for k, c in zip(own, kept(keep, _REPORT), strict=True)],
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that hold no window of the benchmark, with all columns, unchanged."""
    found, names = find(docs, benchmark, text, **options)
    return found.where(F.size("items") == 0).select(*names).toDF(*docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w, least({WINDOW}, len(w)) AS size FROM benchmark),
p AS (SELECT DISTINCT item, size, array_to_string(w[s:s + size - 1], ' ') AS pattern FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM i WHERE size > 0)),
x AS (SELECT r, s, size, array_to_string(w[s:s + size - 1], ' ') AS pattern
      FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
h AS (SELECT r, s, x.size, item FROM x JOIN p USING (size, pattern)),
n AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS k FROM h) GROUP BY r),
m AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN m USING (r)
"""
