"""N-gram Jaccard join by MinHash banding.

Each distinct text gets a signature of ``bands * rows`` minima over its 5-word
shingles; band and row counts follow from the similarity and the recall asked
for. The shuffle is on band hashes: texts of one bucket become candidates by an
edge to the bucket's least node, never by all pairs.

Candidates are verified on their full shingle sets in tasks of bounded size.
Connected candidates of at most ``BLOCK`` texts are one task. A larger connected
set is verified bucket by bucket, so that a chain of weak candidates costs what
its buckets cost and not the square of the chain; or in whole, if that ships
less text. A bucket (or set) of more than ``BLOCK`` texts is dealt into blocks,
of which each two meet in one task. A pair that shares several buckets counts in
the first of them alone. Each task counts the links of every text and returns a
spanning star for each linked set, not the pairs. No link between candidates is
lost and no cap is set. A group of m texts that are truly alike ships each text
m / BLOCK times, since its links, of which there are m * m, are counted exactly.

Only texts of candidates are shuffled for that: the others are left out first,
by a broadcast of the candidates' keys while these are counted to be few.

Equal texts are one node with a number of copies, so a group of copies costs
one row after a map-side aggregation.

Defined results. A document: class_id (the least doc_id of its class, which is
what verified links and equal texts connect), n_links (other documents that are
equal or similar, copies counted) and n_copies. A text of one to four words has
one shingle, all its words; a text without words links to equal texts only; a
null text is a class of its own with no links. Words are
``[^\\x20\\x09-\\x0D]+``, unchanged. Repeated rows count as documents. An empty
table gives an empty result. Extra columns pass through ``keep_one`` whatever
their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import semi_join, spread_join, stored, table, text_key
from .textvec import EXACT, Runs, Texts, U, blocks, mix, release, slices

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
BLOCK = 256
BLOCK_BYTES = 1 << 18
_COLUMNS = 8192


def band_count(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands by which a pair of this similarity collides with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)))


def shingles(t: Texts, words: int) -> tuple[np.ndarray, np.ndarray]:
    """document, hash: of every shingle, in order of documents, repeats included."""
    runs = Runs(t.word_hashes(EXACT))
    w = t.windows(words)
    doc, value = t.doc[w], runs.hash(w, w + words)
    short = np.flatnonzero((t.count > 0) & (t.count < words))
    if len(short):
        doc = np.concatenate((doc, short))
        value = np.concatenate((value, runs.hash(t.first[short], t.first[short + 1])))
        order = np.argsort(doc, kind="stable")
        doc, value = doc[order], value[order]
    return doc, value


def signatures(column: pa.Array, words: int, bands: int, rows: int) -> pa.ListArray:
    """For each text its band hashes; none for a text without words."""
    t = Texts(column)
    doc, value = shingles(t, words)
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    out = np.zeros((len(begin), bands), U)
    factor = mix(np.arange(1, bands * rows + 1, dtype=U)) | U(1)
    work = np.empty_like(value)
    if len(begin):
        for band in range(bands):
            for row in range(band * rows, (band + 1) * rows):
                np.multiply(value, factor[row], out=work)
                out[:, band] = mix(out[:, band] + np.minimum.reduceat(work, begin))
            out[:, band] += U(band)
    has = np.zeros(t.n + 1, np.int32)
    has[doc[begin] + 1] = bands
    return pa.ListArray.from_arrays(pa.array(np.cumsum(has).astype(np.int32)), pa.array(mix(out).reshape(-1).view(np.int64)))


def _intersections(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """How many values each two of n sets share. (doc, value) are distinct."""
    _, column, many = np.unique(value, return_inverse=True, return_counts=True)
    shared = many[column] > 1
    doc, column = doc[shared], column[shared]
    out = np.zeros((n, n), np.int64)
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        a, b = np.searchsorted(column, (at, at + _COLUMNS))
        if a < b:
            _, narrow = np.unique(column[a:b], return_inverse=True)
            dense = np.zeros((n, int(narrow[-1]) + 1), np.float32)
            dense[doc[a:b], narrow] = 1
            out += np.rint(dense @ dense.T).astype(np.int64)
    return out


def _first_shared(bands: np.ndarray, bucket: int) -> np.ndarray:
    """For each two texts whether ``bucket`` is the first that they share."""
    n = len(bands)
    open_, first = np.ones((n, n), bool), np.zeros((n, n), np.int64)
    for band in bands.T:
        same = open_ & (band[:, None] == band[None, :])
        first[same] = np.broadcast_to(band[:, None], (n, n))[same]
        open_ &= ~same
    return ~open_ & (first == bucket)


def _shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """document, hash: of every distinct shingle, in order. The texts are hashed in blocks, since that takes many times their bytes."""
    docs, values, first = [], [], 0
    for block in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), BLOCK_BYTES):
        doc, value = shingles(Texts(block.column(0)), words)
        order = np.lexsort((value, doc))
        doc, value = doc[order], value[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1]))[: len(doc)]
        docs.append(doc[new] + first)
        values.append(value[new])
        first += block.num_rows
    return np.concatenate(docs), np.concatenate(values)


def verify(texts: pa.Array, node: np.ndarray, copies: np.ndarray, side: np.ndarray, bands: np.ndarray | None, bucket: int, words: int, similarity: float):
    """Links of one block, or between two: for each node the linked documents, and the least node that its links here reach.

    With ``bands`` (the buckets of each text) only pairs whose first shared bucket is ``bucket`` count.
    """
    n = len(texts)
    doc, value = _shingle_sets(texts, words)
    size = np.bincount(doc, minlength=n)
    both = _intersections(doc, value, n)
    link = both >= similarity * (size[:, None] + size[None, :] - both) - 1e-9
    link &= (side[:, None] != side[None, :]) if (side != side[0]).any() else ~np.eye(n, dtype=bool)
    link &= both > 0
    if bands is not None:
        link &= _first_shared(bands, bucket)
    links = link @ copies
    root = node.copy()
    while True:
        low = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        low = np.minimum(low, root)
        if (low == root).all():
            return links, root
        root = low


def nodes(keyed: DataFrame, doc_id: str, words: int, bands: int, rows: int) -> DataFrame:
    """node, k1, k2, copies, first_id, bands: one row for each distinct text."""

    def run(batches):
        for block in blocks(batches, BLOCK_BYTES):
            yield pa.RecordBatch.from_arrays([*(block.column(i) for i in (1, 2, 3)), signatures(block.column(0), words, bands, rows)], names=["k1", "k2", "id", "bands"])

    kind = keyed.schema[doc_id].dataType.simpleString()
    each = keyed.select("text", "k1", "k2", F.col(doc_id).alias("id")).mapInArrow(run, f"k1 long, k2 long, id {kind}, bands array<long>")
    one = each.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("bands").alias("bands"))
    return stored(one.withColumn("node", F.monotonically_increasing_id()))


def _buckets(found: DataFrame) -> DataFrame:
    """bucket, v, n: the buckets of two texts or more, with their least node and their size."""
    each = found.select("node", F.explode("bands").alias("bucket"))
    return stored(each.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1"))


def _tasks(found: DataFrame, shared: DataFrame) -> DataFrame:
    """node, task, by_bucket, n: the tasks in which a text is verified, and how many texts each holds."""
    members = spread_join(found.select("node", F.explode("bands").alias("bucket")), shared, "bucket").select("node", "bucket", "v", F.col("n").alias("size"))
    members = stored(members)
    near = stored(components(members.select(F.col("node").alias("u"), "v")))
    sets = stored(near.groupBy("root").agg(F.count("*").alias("n")))
    whole = lambda n: F.ceil(F.col(n) / BLOCK)
    large = sets.where(F.col("n") > BLOCK).select(F.col("root").alias("of_root"), F.col("n").alias("n_set"))
    # texts to ship if a large set is verified by its buckets, from one row a bucket
    of = near.select(F.col("node").alias("of_node"), "root")
    cost = shared.join(of, F.col("v") == F.col("of_node")).join(large, F.col("root") == F.col("of_root"))
    cost = cost.groupBy("of_root", "n_set").agg(F.sum(F.col("n") * whole("n")).alias("cost"))
    split = stored(cost.where(F.col("cost") < F.col("n_set") * whole("n_set")).select(F.col("of_root").alias("split_root")))
    by_set = spread_join(near, sets, "root").join(split, F.col("root") == F.col("split_root"), "left_anti")
    by_set = by_set.select("node", F.col("root").alias("task"), F.lit(False).alias("by_bucket"), "n")
    chosen = shared.join(of, F.col("v") == F.col("of_node")).join(split, F.col("root") == F.col("split_root"), "left_semi").select(F.col("bucket").alias("task"), "n")
    by_bucket = spread_join(members.select("node", F.col("bucket").alias("task")), stored(chosen), "task")
    return stored(by_set.unionByName(by_bucket.select("node", "task", F.lit(True).alias("by_bucket"), "n")))


def links(found: DataFrame, keyed: DataFrame, words: int, similarity: float) -> DataFrame:
    """u, v, links: for each text and task, how many documents it links to there and the least node it is linked with."""
    tasks = _tasks(found, _buckets(found))
    own = tasks.select("node").distinct()
    wanted = stored(found.join(own, "node").select("node", "copies", "bands", F.col("k1").alias("m1"), F.col("k2").alias("m2")))
    match = (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2"))
    text = semi_join(keyed.select("text", "k1", "k2"), wanted.select("m1", "m2"), match).groupBy("k1", "k2").agg(F.first("text").alias("text"))
    members = wanted.join(text, match).select("node", "copies", "bands", "text")
    dealt = tasks.withColumn("n_blocks", F.ceil(F.col("n") / BLOCK))
    side = F.pmod(F.xxhash64("node"), F.col("n_blocks"))
    dealt = dealt.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    dealt = dealt.select("node", "task", "by_bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    spread = dealt.join(members, "node").select("task", "by_bucket", "i", "j", "node", "copies", "side", F.when(F.col("by_bucket"), F.col("bands")).alias("bands"), "text")
    spread = spread.repartition("task", "by_bucket", "i", "j").sortWithinPartitions("task", "by_bucket", "i", "j")

    def run(batches):
        rest = None
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            *full, rest = _groups(whole)
            yield from (_verified(g, words, similarity) for g in full)
        if rest is not None:
            yield _verified(rest, words, similarity)
        batch = whole = full = rest = None
        release()

    return spread.mapInArrow(run, "u long, v long, links long")


def _groups(rows: pa.Table) -> list[pa.Table]:
    key = [np.asarray(rows.column(i)) for i in range(4)]
    change = np.zeros(rows.num_rows - 1, bool)
    for k in key:
        change |= k[1:] != k[:-1]
    at = [0, *(np.flatnonzero(change) + 1), rows.num_rows]
    return [rows.slice(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def _verified(rows: pa.Table, words: int, similarity: float) -> pa.RecordBatch:
    node, copies, side = (np.asarray(rows.column(i)) for i in (4, 5, 6))
    bands = np.asarray(rows.column(7).combine_chunks().flatten()).reshape(len(node), -1) if rows.column(1)[0].as_py() else None
    count, root = verify(rows.column(8).combine_chunks(), node, copies, side, bands, rows.column(0)[0].as_py(), words, similarity)
    hit = count > 0
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(root[hit]), pa.array(count[hit])], names=["u", "v", "links"])


def classes(keyed: DataFrame, doc_id: str, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """k1, k2, copies, first_id, n_links, class_id, class_root: one row for each distinct text. ``keyed`` has text, k1, k2 and ``doc_id``."""
    found = nodes(keyed.where(F.col("text").isNotNull()), doc_id, words, band_count(similarity, recall, ROWS), ROWS)
    linked = stored(links(found, keyed.where(F.col("text").isNotNull()), words, similarity))
    root = components(linked.select("u", "v")).withColumnsRenamed({"node": "node_", "root": "class_root"})
    count = linked.groupBy(F.col("u").alias("linked")).agg(F.sum("links").alias("links"))
    out = found.drop("bands").join(root, F.col("node") == F.col("node_"), "left").join(count, F.col("node") == F.col("linked"), "left")
    out = out.withColumn("class_root", F.coalesce("class_root", "node")).withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    names = out.groupBy(F.col("class_root").alias("named")).agg(F.min("first_id").alias("class_id"))
    return out.join(names, F.col("class_root") == F.col("named")).select("node", "k1", "k2", "copies", "first_id", "n_links", "class_id", "class_root")


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(text).alias("text"), F.col(doc_id).alias("id"), *text_key(F.col(text)))


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, class_id, n_links, n_copies: one row for each document."""
    found = classes(_keyed(docs, text, doc_id), "id", **options).select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), "class_id", "n_links", "copies")
    rows = _keyed(docs, text, doc_id).select("id", "k1", "k2")
    out = rows.join(found, (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")), "left")
    return out.select(
        F.col("id").alias(doc_id),
        F.when(F.col("f1").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with all its columns: the one of the least doc_id, of rows that repeat it any one.

    Null texts all stay.
    """
    found = classes(_keyed(docs, text, doc_id), "id", **options)
    best = found.groupBy("class_root").agg(F.min_by(F.struct("k1", "k2", "first_id"), F.struct(F.col("first_id").isNull(), "first_id", "node")).alias("best"))
    best = best.select(F.col("best.k1").alias("f1"), F.col("best.k2").alias("f2"), F.col("best.first_id").alias("f_id"))
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    own = {c: k for k, c in names.items()}
    rows = docs.toDF(*names)
    rows = rows.withColumns(dict(zip(("k1", "k2"), text_key(F.col(own[text])), strict=True)))
    same = (F.col("k1") == F.col("f1")) & (F.col("k2") == F.col("f2")) & F.col(own[doc_id]).eqNullSafe(F.col("f_id"))
    kept = rows.where(F.col(own[text]).isNotNull()).join(best, same, "left_semi").dropDuplicates(["k1", "k2", own[doc_id]])
    return kept.unionByName(rows.where(F.col(own[text]).isNull())).select(*names).toDF(*docs.columns)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT r, array_to_string(w[s:s + {WORDS} - 1], ' ') AS gram FROM (SELECT r, w, unnest(range(1, greatest(len(w) - {WORDS} + 1, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS k FROM g GROUP BY r),
i AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.r < b.r GROUP BY ALL),
p AS (SELECT u, v FROM i JOIN n a ON a.r = u JOIN n b ON b.r = v WHERE c >= {SIMILARITY} * (a.k + b.k - c) - 1e-9
      UNION SELECT a.r, b.r FROM d a JOIN d b ON a.text = b.text AND a.r < b.r),
l AS (SELECT u, v FROM p UNION SELECT v, u FROM p),
reach(u, v) AS (SELECT r, r FROM d UNION SELECT reach.u, l.v FROM reach JOIN l ON reach.v = l.u),
k AS (SELECT u AS r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = v GROUP BY u),
m AS (SELECT u AS r, count(*) AS n_links FROM l GROUP BY u)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, (CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY text) END)::BIGINT AS n_copies
FROM d JOIN k USING (r) LEFT JOIN m USING (r)
"""
