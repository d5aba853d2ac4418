"""Queries of urls, partial reads and tensors of files."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import tables as T
from ..operators.sequences import offset_order
from ..sources import binary as B
from ..sources import urls as U
from .data import quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_LINKS = ["<a href='https://download.pytorch.org/models/resnet18-f37072fd.pth'>", "https://download.pytorch.org/models/x.pth.tar.gz https://download.pytorch.org/models/y.pt", "https://download.pytorch.org/models/no.bin", ""]


@_add("""SELECT page_id, unnest(CASE page_id % 4 WHEN 0 THEN ['https://download.pytorch.org/models/resnet18-f37072fd.pth'] WHEN 1 THEN ['https://download.pytorch.org/models/x.pth.tar.gz', 'https://download.pytorch.org/models/y.pt'] ELSE [] END) AS url FROM pages""")
def weight_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = F.element_at(F.array(*[F.lit(x) for x in _LINKS]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(U.weight_urls(F.concat(F.coalesce("html", F.lit("")), link))).alias("url"))


#: By hand: url, whether an object store, protocol, url for Spark, namespace, name, branch, file.
URLS = [
    ("s3://b/k", True, "s3", "s3a://b/k", None, None, None, None),
    ("https://b.s3.amazonaws.com/a/k", True, "s3", "s3a://b/a/k", None, None, None, None),
    ("https://storage.googleapis.com/b/k", True, "gcs", "gs://b/k", None, None, None, None),
    ("gcs://b/k", True, "gcs", "gs://b/k", None, None, None, None),
    ("r2://b/k", True, "s3", "s3a://b/k", None, None, None, None),
    ("https://x.r2.cloudflarestorage.com/k", True, "s3", "https://x.r2.cloudflarestorage.com/k", None, None, None, None),
    ("https://example.org/x", False, None, "https://example.org/x", None, None, None, None),
    ("hf://org/model", False, None, "hf://org/model", "org", "model", None, None),
    ("hf://bert", False, None, "hf://bert", "bert", "", None, None),
    ("hf://a/b/c", False, None, "hf://a/b/c", None, None, None, None),
    ("https://huggingface.co/org/model/resolve/main/a%20b/c.bin", False, None, "https://huggingface.co/org/model/resolve/main/a%20b/c.bin", "org", "model", "main", "a b/c.bin"),
    ("https://hf.co/gpt2/", False, None, "https://hf.co/gpt2/", "gpt2", "", None, None),
]
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else quoted(x) for x in r) + ")" for r in URLS)


@_add(f"SELECT page_id, u AS url, c AS is_cloud, p AS protocol, s AS spark_url, n AS namespace, m AS name, b AS branch, f AS filename FROM pages JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {_ROWS}) t(u, c, p, s, n, m, b, f)) ON k = page_id % {len(URLS)}")
def url_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*[F.lit(u[0]) for u in URLS]), (F.col("page_id") % len(URLS) + 1).cast("int")).alias("url"))
    u = F.col("url")
    return pages.select("page_id", "url", U.is_cloud(u).alias("is_cloud"), U.protocol(u).alias("protocol"), U.spark_url(u).alias("spark_url"), U.repository(u)["namespace"].alias("namespace"), U.repository(u)["name"].alias("name"), U.repository_file(u)["branch"].alias("branch"), U.repository_file(u)["filename"].alias("filename"))


@_add("""WITH s AS (SELECT doc_id, n_chars * (doc_id % 900)::BIGINT AS size FROM documents), t AS (SELECT *, size / 1250000.0 AS sec FROM s)
SELECT doc_id, CASE WHEN size = 0 THEN 'instant' WHEN sec < 60 THEN floor(sec)::BIGINT || ' seconds' WHEN sec < 3600 THEN floor(sec / 60)::BIGINT || ' minutes' ELSE format('{:.1f} hours', sec / 3600) END AS takes FROM t""")
def download_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", U.download_time(F.col("n_chars") * (F.col("doc_id") % 900)).alias("takes"))


_PATTERNS = [p for p in T.BINARY_CODE if "'" not in p]


@_add(f"""SELECT doc_id::VARCHAR AS path, least(strlen(text), 500)::BIGINT AS bytes_analyzed, strlen(text) <= 500 AS analysis_complete FROM documents""")
def partial_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), F.octet_length("text").cast("long").alias("length"))
    return B.partial(files, 500).select("path", "bytes_analyzed", "analysis_complete")


@_add(f"""WITH f AS (SELECT doc_id, coalesce(text, '') || ([{', '.join(map(quoted, _PATTERNS))}])[(doc_id % {len(_PATTERNS)} + 1)::INT] AS t FROM documents), p AS (SELECT unnest([{', '.join(map(quoted, _PATTERNS))}]) AS pattern)
SELECT doc_id::VARCHAR AS path, pattern FROM f JOIN p ON contains(t, pattern)""")
def binary_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.element_at(F.array(*[F.lit(p) for p in _PATTERNS]), (F.col("doc_id") % len(_PATTERNS) + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(F.coalesce("text", F.lit("")), extra).cast("binary").alias("content"))
    return B.search(files, _PATTERNS)


def _gguf(tensors: list[tuple[str, list[int], int, int]], size: int) -> bytes:
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), 0)
    for name, dims, kind, offset in tensors:
        head += text(name) + struct.pack("<I", len(dims)) + struct.pack(f"<{len(dims)}Q", *dims) + struct.pack("<IQ", kind, offset)
    return head + bytes(-len(head) % 32 + size)


#: Files by doc_id modulo their number, and by hand the problems of their tensors.
_GGUF = [
    _gguf([("a", [8], 0, 0), ("b", [8], 0, 32)], 64),
    _gguf([("a", [64], 0, 0), ("b", [8], 0, 32)], 64),  # a needs 256 bytes and has 32
    _gguf([("a", [8], 0, 64), ("b", [8], 0, 32)], 96),  # offsets fall; b has 64 bytes, 32 more than it needs, which is the alignment
    _gguf([("a", [8], 0, 0)], 200),  # 168 bytes too many
    _gguf([("a", [64], 2, 0)], 36),  # two blocks of 18 bytes
]


@_add(f"SELECT doc_id::VARCHAR AS path, idx::BIGINT AS idx, problem FROM documents JOIN (VALUES (1, 0, 'size'), (2, 0, 'order'), (3, 0, 'size')) t(k, idx, problem) ON k = doc_id % {len(_GGUF)}")
def gguf_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.element_at(F.array(*[F.unhex(F.lit(g.hex())) for g in _GGUF]), (F.col("doc_id") % len(_GGUF) + 1).cast("int"))
    tensors = B.gguf_tensors(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    elements = F.aggregate("dims", F.lit(1).cast("long"), lambda a, d: F.try_multiply(a, d))
    return offset_order(tensors.where("error is null"), "path", "idx", K.ggml_bytes(F.col("kind"), elements))
