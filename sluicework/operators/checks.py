"""Checks and issues: the order of operations on a finding, consolidation, deduplication, counts and exit code.

A check row has seq, name, status (passed, failed, skipped), severity, message,
location, why, rule_code and ts. ``seq`` is the order in which checks were
made; whatever depends on that order uses it and nothing else.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severities, the lowest first; configured rule severities and what they become.
SEVERITIES = ["debug", "info", "warning", "critical"]
CONFIGURED = {"CRITICAL": "critical", "HIGH": "critical", "MEDIUM": "warning", "LOW": "info", "INFO": "info"}


def rank(severity: Column) -> Column:
    """0 to 3; null for null. Names don't sort as severities do."""
    out = None
    for i, s in enumerate(SEVERITIES):
        out = (F if out is None else out).when(severity == s, F.lit(i))
    return out


def asset_of(location: Column) -> Column:
    """The file of a location: its first word up to a colon, but for that of a drive; "unknown" where there is none."""
    path = F.regexp_extract(F.coalesce(location, F.lit("")), r"^\s*((?:[A-Za-z]:(?=[\\/]))?[^\s:]*)", 1)
    return F.when(path == "", "unknown").otherwise(path)


def glob_regex(glob: str) -> str:
    """A shell pattern as a regular expression for whole strings: "*", "?", "[abc]" and "[!abc]"."""
    out, i = "", 0
    while i < len(glob):
        c, i = glob[i], i + 1
        end = glob.find("]", i + 1 + glob.startswith("!", i)) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end >= 0:
            inside = glob[i:end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&").replace("^", r"\^")
            out += f"[^{inside[1:]}]" if inside.startswith("!") else f"[{inside}]"
            i = end + 1
        else:
            out += re.escape(c)
    return rf"(?s)^{out}(?![\s\S])"


def apply_policy(findings: DataFrame, suppressions: DataFrame | None = None, overrides: DataFrame | None = None, whitelist: DataFrame | None = None) -> DataFrame:
    """Suppression, severity override, default severity and whitelist downgrade, in this order.

    suppressions: code, glob (null: everywhere; code "ALL": every code).
    overrides: code, configured. whitelist: model_id; findings then have model_id.
    The small tables are joined by key and left to the planner, which
    broadcasts what is small; path patterns become predicates.
    """
    out = findings
    if suppressions is not None:
        by_code = suppressions.where("glob is null").select(F.col("code").alias("s_code")).distinct()
        out = out.join(by_code, F.col("rule_code") == F.col("s_code"), "left_anti")
        base = F.regexp_extract("location", r"([^/]*)$", 1)
        codes: dict[str, list[str]] = {}
        for g in suppressions.where("glob is not null").distinct().toLocalIterator():
            codes.setdefault(g.code, []).append(glob_regex(g.glob))
        for code, patterns in codes.items():  # one predicate a code, its patterns joined
            joined = "|".join(f"(?:{p})" for p in sorted(patterns))
            hit = (F.col("location").rlike(joined) | base.rlike(joined)) & ((F.col("rule_code") == code) | (F.lit(code == "ALL") & F.col("rule_code").isNotNull()))
            out = out.where(~F.coalesce(hit, F.lit(False)))
    if overrides is not None:
        mapped = None
        for k, v in CONFIGURED.items():
            mapped = (F if mapped is None else mapped).when(F.col("configured") == k, F.lit(v))
        small = overrides.select(F.col("code").alias("o_code"), mapped.alias("o_severity"))
        out = out.join(small, F.col("rule_code") == F.col("o_code"), "left").withColumn("severity", F.coalesce("o_severity", "severity")).drop("o_code", "o_severity")
    out = out.withColumn("severity", F.when((F.col("status") == "failed") & F.col("severity").isNull(), "warning").otherwise(F.col("severity")))
    if whitelist is not None:
        known = whitelist.select(F.col("model_id").alias("w_id")).distinct()
        out = out.join(known, F.col("model_id") == F.col("w_id"), "left")
        lower = (F.col("status") == "failed") & F.col("w_id").isNotNull() & (rank(F.col("severity")) > 1)
        out = out.withColumn("original_severity", F.when(lower, F.col("severity"))).withColumn("severity", F.when(lower, "info").otherwise(F.col("severity"))).drop("w_id")
    return out


def consolidate(checks: DataFrame) -> DataFrame:
    """One row for each (name, asset). A single check keeps its status and rule code; of more, failed wins over passed over skipped.

    If checks have details (JSON), findings holds those of the failed ones in order.
    """
    failed = F.col("status") == "failed"
    first = lambda c: F.min(F.when(failed & F.col(c).isNotNull(), F.struct("seq", c)))[c]
    own = F.min_by(F.struct("status", "message", "severity", "why", "rule_code"), "seq")
    g = checks.groupBy("name", asset_of(F.col("location")).alias("asset")).agg(
        F.count("*").alias("n"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(F.col("status") == "passed").alias("n_passed"),
        own.alias("own"),
        first("severity").alias("f_severity"),
        first("why").alias("f_why"),
        F.count_distinct(F.when(failed, F.col("message"))).alias("f_messages"),
        F.min(F.when(failed, F.col("message"))).alias("f_message"),
        F.count_distinct(F.when(F.col("status") == "passed", F.col("message"))).alias("p_messages"),
        F.min(F.when(F.col("status") == "passed", F.col("message"))).alias("p_message"),
        F.max("ts").alias("ts"),
        *([F.transform(F.array_sort(F.collect_list(F.when(failed & F.col("details").isNotNull(), F.struct("seq", "details")))), lambda x: x["details"]).alias("findings")] if "details" in checks.columns else []),
    )
    many = F.col("n") > 1
    status = F.when(F.col("n_failed") > 0, "failed").when(F.col("n_passed") > 0, "passed").otherwise("skipped")
    passed = F.when(F.col("p_messages") == 1, F.col("p_message")).otherwise(F.concat("name", F.lit(" completed successfully")))
    issues = F.when(F.col("f_messages") == 1, F.col("f_message")).when(F.col("n_failed") == 1, F.concat("name", F.lit(" found 1 issue")))
    issues = issues.otherwise(F.concat("name", F.lit(" found "), F.col("n_failed").cast("string"), F.lit(" issues")))
    return g.select(
        "name",
        "asset",
        F.col("n").alias("component_count"),
        F.when(many, status).otherwise(F.col("own.status")).alias("status"),
        F.when(many, F.when(status == "passed", passed).otherwise(issues)).otherwise(F.col("own.message")).alias("message"),
        F.when(many, F.col("f_severity")).otherwise(F.col("own.severity")).alias("severity"),
        F.when(many, F.col("f_why")).otherwise(F.col("own.why")).alias("why"),
        F.when(~many, F.col("own.rule_code")).alias("rule_code"),
        "ts",
        *(["findings"] if "details" in checks.columns else []),
    )


def informational() -> Column:
    """Failed checks of severity info or debug, which success rates leave out. A null severity isn't one."""
    return (F.col("status") == "failed") & F.coalesce(F.col("severity").isin("info", "debug"), F.lit(False))


def counts(checks: DataFrame) -> DataFrame:
    """total, passed, failed and skipped checks without the informational ones."""
    return checks.where(~informational()).agg(
        F.count("*").alias("total_checks"),
        F.count_if(F.col("status") == "passed").alias("passed_checks"),
        F.count_if(F.col("status") == "failed").alias("failed_checks"),
        F.count_if(~F.col("status").isin("passed", "failed")).alias("skipped_checks"),
    )


def dedup_issues(issues: DataFrame) -> DataFrame:
    """The first issue by seq of each (message, severity, location or empty)."""
    key = ["message", "severity", F.coalesce("location", F.lit("")).alias("place")]
    columns = [c for c in issues.columns if c not in ("message", "severity")]
    best = issues.groupBy(*key).agg(F.min_by(F.struct(*columns), "seq").alias("best"))
    return best.select("message", "severity", *[F.col(f"best.{c}").alias(c) for c in columns]).select(*issues.columns)


def visible(issues: DataFrame, verbose: bool = False) -> DataFrame:
    """Without debug rows unless verbose; a null severity stays."""
    return issues if verbose else issues.where(~F.col("severity").eqNullSafe("debug"))


def severity_counts(issues: DataFrame) -> DataFrame:
    """severity, n for all four severities, zero where there is none."""
    every = issues.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    found = issues.groupBy(F.col("severity").alias("s")).agg(F.count("*").alias("k"))
    return every.join(found, F.col("severity") == F.col("s"), "left").select("severity", F.coalesce("k", F.lit(0)).alias("n"))


def exit_code(issues: DataFrame, files_scanned: Column, has_errors: Column) -> DataFrame:
    """2 for operational errors or no files, 1 for warnings or worse, else 0."""
    bad = issues.agg(F.count_if(rank(F.col("severity")) >= 2).alias("bad"))
    return bad.select(F.when(has_errors | (files_scanned == 0), 2).when(F.col("bad") > 0, 1).otherwise(0).alias("exit_code"))


def summaries(findings: DataFrame, asset: str, seq: str, message: str, first: int = 10, clip: int = 200) -> DataFrame:
    """asset, total, first_findings: how many findings an asset has and the first of them, clipped, joined by "; ".

    Only the first of each task reach the aggregation that puts them in order.
    """
    totals = findings.groupBy(F.col(asset).alias("of")).agg(F.count("*").alias("total"))
    place = F.row_number().over(Window.partitionBy(asset).orderBy(seq))
    some = findings.withColumn("n_", place).where(F.col("n_") <= first)
    text = F.when(F.length(message) > clip, F.concat(F.left(message, F.lit(clip)), F.lit("..."))).otherwise(F.col(message))
    listed = some.groupBy(asset).agg(F.array_sort(F.collect_list(F.struct("n_", text.alias("m")))).alias("l"))
    return listed.join(totals, F.col(asset) == F.col("of")).select(asset, "total", F.array_join(F.transform("l", lambda x: x["m"]), "; ").alias("first_findings"))


def merged(*results: DataFrame) -> DataFrame:
    """Partial results as one: what a part lacks is null."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r, allowMissingColumns=True)
    return out


def ordered_distinct(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """key, names: the distinct names of each key in the order of their first row."""
    first = rows.groupBy(key, name).agg(F.min(order).alias("first_"))
    listed = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first_", F.col(name).alias("n")))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["n"]).alias("names"))


def license_rollup(licenses: DataFrame, spdx: DataFrame, group: str, file: str, first: int = 5) -> DataFrame:
    """group, kind, n_files, first_files: files by what their licences ask for. licenses: file, spdx_id, commercial_allowed; spdx: id, is_deprecated, is_osi (a dimension table, joined by key)."""
    rows = licenses.join(spdx, F.col("spdx_id") == F.col("id"), "left")
    named = lambda w: F.contains("spdx_id", F.lit(w))
    kinds = {"agpl": named("AGPL"), "non_commercial": ~F.col("commercial_allowed"), "copyleft": named("GPL-") | named("AGPL-"), "deprecated": F.coalesce("is_deprecated", F.lit(False)), "not_approved": ~F.coalesce("is_osi", F.lit(True))}
    each = rows.select(group, F.col(file).alias("f_"), F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds.items()]))).alias("kind")).distinct()
    place = F.row_number().over(Window.partitionBy(group, "kind").orderBy("f_"))
    return each.withColumn("n_", place).groupBy(group, "kind").agg(F.count("*").alias("n_files"), F.array_sort(F.collect_list(F.when(F.col("n_") <= first, F.col("f_")))).alias("first_files"))
