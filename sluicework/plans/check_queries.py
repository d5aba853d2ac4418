"""Queries on checks and issues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks as C
from .data import CHECKS, checks

QUERIES, SQL = {}, {}
_KEEP = ["seq", "name", "status", "severity", "message", "location", "rule_code"]


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


@_add(f"""WITH {CHECKS}, f AS (SELECT * FROM assets WHERE status = 'failed' AND severity IS NOT NULL),
fw AS (SELECT * FROM assets WHERE status = 'failed' AND why IS NOT NULL),
s AS (SELECT name, asset, arg_min(severity, seq) AS v FROM f GROUP BY ALL), w AS (SELECT name, asset, arg_min(why, seq) AS v FROM fw GROUP BY ALL),
g AS (SELECT name, asset, count(*) AS n, count(*) FILTER (status = 'failed') AS nf, count(*) FILTER (status = 'passed') AS np,
 arg_min(status, seq) AS s1, arg_min(message, seq) AS m1, min(seq) AS q1,
 count(DISTINCT message) FILTER (status = 'failed') AS fm, min(message) FILTER (status = 'failed') AS fmin,
 count(DISTINCT message) FILTER (status = 'passed') AS pm, min(message) FILTER (status = 'passed') AS pmin, max(ts) AS ts FROM assets GROUP BY name, asset),
x AS (SELECT *, CASE WHEN nf > 0 THEN 'failed' WHEN np > 0 THEN 'passed' ELSE 'skipped' END AS st FROM g)
SELECT x.name, x.asset, n AS component_count, CASE WHEN n > 1 THEN st ELSE s1 END AS status,
 CASE WHEN n = 1 THEN m1 WHEN st = 'passed' THEN CASE WHEN pm = 1 THEN pmin ELSE x.name || ' completed successfully' END
  WHEN fm = 1 THEN fmin WHEN nf = 1 THEN x.name || ' found 1 issue' ELSE x.name || ' found ' || nf || ' issues' END AS message,
 CASE WHEN n > 1 THEN s.v ELSE a.severity END AS severity, CASE WHEN n > 1 THEN w.v ELSE a.why END AS why,
 CASE WHEN n = 1 THEN a.rule_code END AS rule_code, x.ts
FROM x LEFT JOIN s ON s.name = x.name AND s.asset = x.asset LEFT JOIN w ON w.name = x.name AND w.asset = x.asset JOIN checks a ON a.seq = q1""")
def consolidate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.consolidate(checks(spark, sf_dir))


_INFO = "(status = 'failed' AND coalesce(severity IN ('info', 'debug'), false))"


@_add(f"""WITH {CHECKS} SELECT count(*) AS total_checks, count(*) FILTER (status = 'passed') AS passed_checks, count(*) FILTER (status = 'failed') AS failed_checks,
count(*) FILTER (status NOT IN ('passed', 'failed')) AS skipped_checks FROM checks WHERE NOT {_INFO}""")
def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.counts(checks(spark, sf_dir))


@_add(f"""WITH {CHECKS} SELECT seq, name, status, severity, message, location, rule_code FROM checks WHERE status = 'failed'
QUALIFY row_number() OVER (PARTITION BY message, severity, coalesce(location, '') ORDER BY seq) = 1""")
def issue_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.dedup_issues(checks(spark, sf_dir).where("status = 'failed'").select(*_KEEP))


@_add(f"""WITH {CHECKS} SELECT seq, name, status, severity, message, location, rule_code FROM checks
WHERE NOT coalesce(rule_code = 'S101' OR (rule_code = 'S102' AND regexp_matches(location, '^/models/1.*$')) OR (rule_code IS NOT NULL AND regexp_matches(regexp_extract(location, '([^/]*)$', 1), '^5\\.pkl.*$')), false)""")
def suppressed_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([("S101", None), ("S102", "/models/1*"), ("ALL", "5.pkl*")], "code string, glob string")
    kept = C.apply_policy(checks(spark, sf_dir), rules).select(F.col("seq").alias("kept"))
    return checks(spark, sf_dir).join(kept, F.col("seq") == F.col("kept"), "left_semi").select(*_KEEP)


@_add(f"""WITH {CHECKS}, o AS (SELECT * FROM (VALUES ('S102', 'critical'), ('S103', 'info')) t(code, sev)),
x AS (SELECT c.*, coalesce(o.sev, c.severity, CASE WHEN status = 'failed' THEN 'warning' END) AS s FROM checks c LEFT JOIN o ON rule_code = code)
SELECT seq, name, status, CASE WHEN low THEN 'info' ELSE s END AS severity, CASE WHEN low THEN s END AS original_severity, rule_code, model_id
FROM (SELECT *, status = 'failed' AND s IN ('warning', 'critical') AND model_id IN ('org/model3', 'org/model7') AS low FROM x)""")
def severity_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    overrides = spark.createDataFrame([("S102", "HIGH"), ("S103", "LOW")], "code string, configured string")
    whitelist = spark.createDataFrame([("org/model3",), ("org/model7",)], "model_id string")
    out = C.apply_policy(checks(spark, sf_dir), None, overrides, whitelist)
    return out.select("seq", "name", "status", "severity", "original_severity", "rule_code", "model_id")


@_add(f"""WITH {CHECKS} SELECT s AS severity, (SELECT count(*) FROM checks WHERE severity = s AND status = 'failed') AS n FROM (VALUES ('debug'), ('info'), ('warning'), ('critical')) t(s)""")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.severity_counts(checks(spark, sf_dir).where("status = 'failed'"))


@_add(f"WITH {CHECKS} SELECT seq, severity FROM checks WHERE severity IS DISTINCT FROM 'info'")
def visible_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = checks(spark, sf_dir).withColumn("severity", F.when(F.col("severity") == "info", "debug").otherwise(F.col("severity")))
    return C.visible(renamed).select("seq", "severity")


@_add(f"""WITH {CHECKS} SELECT CASE WHEN (SELECT count(DISTINCT asset) FROM assets) = 0 THEN 2
WHEN (SELECT count(*) FROM checks WHERE severity IN ('warning', 'critical')) > 0 THEN 1 ELSE 0 END AS exit_code""")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.exit_code(checks(spark, sf_dir), F.lit(1), F.lit(False))


@_add(f"""WITH {CHECKS} SELECT asset, max(CASE severity WHEN 'debug' THEN 0 WHEN 'info' THEN 1 WHEN 'warning' THEN 2 WHEN 'critical' THEN 3 END) AS max_rank, count(*) AS n_issues,
least(sum(CASE severity WHEN 'critical' THEN 5 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END), 10)::BIGINT AS risk FROM assets WHERE status = 'failed' GROUP BY asset""")
def asset_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = checks(spark, sf_dir).where("status = 'failed'")
    weight = F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "warning", 2).when(F.col("severity") == "info", 1).otherwise(0)
    return failed.groupBy(C.asset_of(F.col("location")).alias("asset")).agg(F.max(C.rank(F.col("severity"))).alias("max_rank"), F.count("*").alias("n_issues"), F.least(F.sum(weight), F.lit(10)).alias("risk"))


@_add(f"""WITH {CHECKS} SELECT name, min(seq) AS first_seq, count(*) AS n FROM checks WHERE status = 'failed' GROUP BY name ORDER BY first_seq LIMIT 5""")
def first_check_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir).where("status = 'failed'").groupBy("name").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n")).orderBy("first_seq").limit(5)
