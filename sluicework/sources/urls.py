"""Where models come from: what a url names, and the weight files that a page links to. Reading is left to Spark's own file systems."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import tables as T

#: Weight files of a hub page, hosts of model repositories.
WEIGHTS = r"https://download\.pytorch\.org/models/[\w\-_.]+(?:\.pt|\.pth(?:\.tar\.gz|\.zip)?)(?![\w.])"
HUBS = ["huggingface.co", "hf.co"]


def weight_urls(html: Column) -> Column:
    """The weight files that a page links to, in order."""
    return F.regexp_extract_all(html, F.lit(WEIGHTS), F.lit(0))


def is_cloud(url: Column) -> Column:
    """Whether the url names an object store."""
    hit = F.lit(False)
    for p in T.CLOUD_URLS:
        hit = hit | url.rlike(p)
    return hit


def protocol(url: Column) -> Column:
    """s3 or gcs; null for others."""
    scheme, host = F.regexp_extract(url, r"^([a-z0-9]+)://", 1), F.regexp_extract(url, r"^[a-z0-9]+://([^/]*)", 1)
    web = F.when(F.endswith(host, F.lit(".s3.amazonaws.com")) | F.endswith(host, F.lit(".r2.cloudflarestorage.com")), "s3").when(host == "storage.googleapis.com", "gcs")
    return F.when(scheme.isin("http", "https"), web).when(scheme.isin("gcs", "gs"), "gcs").when(scheme.isin("s3", "r2"), "s3")


def spark_url(url: Column) -> Column:
    """The url as Spark's file systems take it: s3a:// or gs://."""
    bucket = F.regexp_extract(url, r"^https?://([^./]+)\.s3\.amazonaws\.com/", 1)
    key = F.regexp_extract(url, r"^[a-z0-9]+://[^/]*/(.*)$", 1)
    return (
        F.when(bucket != "", F.concat(F.lit("s3a://"), bucket, F.lit("/"), key))
        .when(F.startswith(url, F.lit("https://storage.googleapis.com/")), F.concat(F.lit("gs://"), key))
        .when(url.rlike("^(s3|r2)://"), F.regexp_replace(url, "^(s3|r2)://", "s3a://"))
        .when(url.rlike("^gcs://"), F.regexp_replace(url, "^gcs://", "gs://"))
        .otherwise(url)
    )


def repository(url: Column) -> Column:
    """namespace, name of a hub url (a single name has no namespace, it is one); null for what is none."""
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    path = F.when(F.startswith(url, F.lit("hf://")), F.substring(url, 6, 1 << 20)).when(host.isin(*HUBS), F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1))
    parts = F.split(F.regexp_replace(F.try_url_decode(path), "^/+|/+$", ""), "/")
    first, n = F.get(parts, 0), F.size(parts)
    fits = (first != "") & (~F.startswith(url, F.lit("hf://")) | (n <= 2))
    return F.when(path.isNotNull() & fits, F.struct(first.alias("namespace"), F.coalesce(F.get(parts, 1), F.lit("")).alias("name")))


def repository_file(url: Column) -> Column:
    """repo_id, branch, filename of a hub's file url; null for what is none."""
    host = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    parts = F.split(F.regexp_replace(F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1), "^/+|/+$", ""), "/")
    fits = host.isin(*HUBS) & (F.size(parts) >= 5) & (F.get(parts, 2) == "resolve")
    rest = F.array_join(F.transform(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), F.try_url_decode), "/")
    return F.when(fits, F.struct(F.concat_ws("/", F.get(parts, 0), F.get(parts, 1)).alias("repo_id"), F.try_url_decode(F.get(parts, 3)).alias("branch"), rest.alias("filename")))


def download_time(size: Column, megabits: float = 10.0) -> Column:
    """How long a download takes, in words."""
    seconds = size / (megabits * 1_000_000 / 8)
    return (
        F.when(size == 0, "instant")
        .when(seconds < 60, F.concat(F.floor(seconds).cast("string"), F.lit(" seconds")))
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" minutes")))
        .otherwise(F.format_string("%.1f hours", seconds / 3600))
    )
