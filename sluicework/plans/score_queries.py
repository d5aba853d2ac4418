"""Queries of scores, explanations, evidence, order and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import tables as T
from ..operators import checks as C
from ..operators import sequences as S
from .data import CHECKS, DOCS, checks, payload_docs, quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def file_risk(confidence: Column, suspicious: Column, depth: Column, licensed: Column) -> Column:
    """Risk of a file from its ML confidence, suspicious findings, nesting and licence; 1 at most."""
    parts = F.when(confidence > 0.7, 0.1).otherwise(0.0) + F.least(0.1 * suspicious, F.lit(0.5)) + F.when(depth > 10, F.least(0.02 * (depth - 10), F.lit(0.3))).otherwise(0.0)
    return F.least(parts + F.when(licensed, 0.0).otherwise(0.1), F.lit(1.0))


@_add("""SELECT doc_id, round(least(CASE WHEN (doc_id % 10) / 10.0 > 0.7 THEN 0.1 ELSE 0 END + least(0.1 * (doc_id % 8), 0.5) + CASE WHEN doc_id % 30 > 10 THEN least(0.02 * (doc_id % 30 - 10), 0.3) ELSE 0 END
+ CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 0.1 END, 1), 6)::DOUBLE AS risk FROM documents""")
def file_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.round(file_risk((i % 10) / 10.0, i % 8, i % 30, i % 3 == 0), 6).alias("risk"))


def explained(messages: DataFrame, message: str, texts: list[tuple[str, str]]) -> DataFrame:
    """Adds why: the text of the first prefix that the message begins with."""
    why = None
    for prefix, text in texts:
        why = (F if why is None else why).when(F.startswith(message, F.lit(prefix)), F.lit(text))
    return messages.withColumn("why", F.lit(None).cast("string") if why is None else why)


_TEXTS = [("click finding 1", "first"), ("click", "clicks"), ("view", "views")]


@_add(f"""WITH {CHECKS} SELECT seq, CASE WHEN starts_with(message, 'click finding 1') THEN 'first' WHEN starts_with(message, 'click') THEN 'clicks' WHEN starts_with(message, 'view') THEN 'views' END AS why FROM checks""")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explained(checks(spark, sf_dir).select("seq", "message"), "message", _TEXTS).select("seq", "why")


@_add("SELECT l_quantity::BIGINT AS dim, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3")
def repeated_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_quantity").cast("long").alias("dim")).agg(F.count("*").alias("n")).where("n >= 3")


@_add(f"""WITH {CHECKS} SELECT seq, severity FROM checks WHERE status = 'failed' AND severity IS NOT NULL
ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, seq LIMIT 50""")
def report_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir).where("status = 'failed' and severity is not null")
    return rows.orderBy(C.rank(F.col("severity")).desc(), "seq").limit(50).select("seq", "severity")


@_add("SELECT o_custkey AS id FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0")
def name_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey"))


@_add(f"""WITH {CHECKS} SELECT DISTINCT rule_code FROM checks WHERE rule_code IS NOT NULL AND rule_code NOT IN ('S101', 'S103')""")
def unknown_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("S101",), ("S103",)], "rule_code string")
    return checks(spark, sf_dir).where("rule_code is not null").select("rule_code").subtract(known)


@_add(f"""WITH {CHECKS}, f AS (SELECT asset, repeat(message, 30) AS message, row_number() OVER (PARTITION BY asset ORDER BY seq) AS n, count(*) OVER (PARTITION BY asset) AS total FROM assets WHERE status = 'failed')
SELECT asset, max(total) AS total, string_agg(CASE WHEN len(message) > 200 THEN left(message, 200) || '...' ELSE message END, '; ' ORDER BY n) AS first_findings FROM f WHERE n <= 10 GROUP BY asset""")
def finding_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir).where("status = 'failed'").select(C.asset_of(F.col("location")).alias("asset"), "seq", F.repeat("message", 30).alias("message"))
    return C.summaries(rows, "asset", "seq", "message")


@_add("""WITH RECURSIVE o AS (SELECT user_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT) AS n FROM (SELECT user_id, date_trunc('second', ts) AS ts FROM events)),
e AS (SELECT user_id, n, t AS last, 1 AS emitted FROM o WHERE n = 1
 UNION ALL SELECT o.user_id, o.n, CASE WHEN o.t - last >= 3600 THEN o.t ELSE last END, emitted + CASE WHEN o.t - last >= 3600 THEN 1 ELSE 0 END FROM e JOIN o ON o.user_id = e.user_id AND o.n = e.n + 1)
SELECT user_id, max(emitted)::BIGINT AS emitted FROM e GROUP BY user_id""")
def throttled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.throttled(table(spark, sf_dir, "events").select("user_id", F.unix_timestamp("ts").alias("at")), "user_id", "at", 3600)


@_add(f"""WITH {CHECKS}, i AS (SELECT *, CASE WHEN seq % 3 = 0 THEN name WHEN seq % 3 = 1 THEN message END AS type FROM checks WHERE status = 'failed') SELECT coalesce(type, 'unknown') AS type, count(*) AS n, count(DISTINCT location) AS n_files FROM i GROUP BY 1""")
def issue_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("seq") % 3 == 0, F.col("name")).when(F.col("seq") % 3 == 1, F.col("message"))
    return checks(spark, sf_dir).where("status = 'failed'").groupBy(F.coalesce(kind, F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"), F.count_distinct("location").alias("n_files"))


@_add(f"""WITH {CHECKS}, a AS (SELECT seq, message, severity, NULL::VARCHAR AS why FROM checks WHERE seq % 2 = 0), b AS (SELECT seq, message, NULL::VARCHAR AS severity, why FROM checks WHERE seq % 2 = 1)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, even = checks(spark, sf_dir), F.col("seq") % 2 == 0
    return C.merged(rows.where(even).select("seq", "message", "severity"), rows.where(~even).select("seq", "message", "why"))


@_add(f"""WITH {CHECKS}, n AS (SELECT asset, name, min(seq) AS first FROM assets WHERE name <> 'view' GROUP BY ALL) SELECT asset, string_agg(name, ',' ORDER BY first) AS scanners FROM n GROUP BY asset""")
def scanner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = checks(spark, sf_dir).select(C.asset_of(F.col("location")).alias("asset"), "seq", "name").where("name <> 'view'")
    return C.ordered_distinct(rows, "asset", "seq", "name").select("asset", F.array_join("names", ",").alias("scanners"))


@_add("""SELECT doc_id, least(size * 8 / 5e7, 1e9)::DOUBLE AS seconds FROM (SELECT doc_id, n_chars * 1000 AS size FROM documents)""")
def download_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") * 1000 * 8 / F.lit(5e7), F.lit(1e9)).alias("seconds"))


#: By hand: licence ids, whether they are deprecated, whether approved.
_SPDX = [("GPL-3.0", True, True), ("AGPL-3.0", True, True), ("CC-BY-NC-4.0", False, False), ("BSD-3-Clause", False, True), ("MIT", False, True)]
_LICENSES = " UNION ALL ".join(
    f"SELECT doc_id, source, {quoted(k)} AS spdx_id, {str(free).lower()} AS commercial_allowed FROM docs WHERE regexp_matches(array_to_string(string_split(text, chr(10))[1:50], chr(10)), {quoted('(?im)' + p)})"
    for p, k, _, free in T.LICENSES
)
_KINDS = {"agpl": "contains(spdx_id, 'AGPL')", "non_commercial": "NOT commercial_allowed", "copyleft": "contains(spdx_id, 'GPL-') OR contains(spdx_id, 'AGPL-')", "deprecated": "coalesce(is_deprecated, false)", "not_approved": "NOT coalesce(is_osi, true)"}


@_add(f"""WITH {DOCS}, l AS ({_LICENSES}), s AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {a}, {b})" for k, a, b in _SPDX)}) t(id, is_deprecated, is_osi)),
j AS (SELECT l.*, is_deprecated, is_osi FROM l LEFT JOIN s ON spdx_id = id), k AS ({' UNION ALL '.join(f"SELECT DISTINCT source, '{n}' AS kind, doc_id FROM j WHERE {c}" for n, c in _KINDS.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY doc_id) AS n FROM k)
SELECT source, kind, count(*) AS n_files, string_agg(doc_id::VARCHAR, ',' ORDER BY n) FILTER (n <= 5) AS first_files FROM r GROUP BY source, kind""")
def license_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.licenses(payload_docs(spark, sf_dir), "text", "doc_id", "source")
    spdx = spark.createDataFrame(_SPDX, "id string, is_deprecated boolean, is_osi boolean")
    out = C.license_rollup(found, spdx, "source", "doc_id")
    return out.select("source", "kind", "n_files", F.array_join(F.transform("first_files", lambda x: x.cast("string")), ",").alias("first_files"))
