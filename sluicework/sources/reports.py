"""Reports: JSON lines, SARIF, a CycloneDX list, text and CSV, made as DataFrames and written by Spark.

A document that is one JSON value is made as ordered lines, a result a line, so
that no row holds all results; the writer puts the lines into one file.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..operators.checks import SEVERITIES, rank

PREFIX = "MA"
SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
#: What a message's words say of a rule, and the tags that they give.
DESCRIPTIONS = [
    (["pickle"], "Potentially unsafe pickle operation detected"),
    (["import"], "Dangerous import statement found"),
    (["exec", "eval"], "Code execution vulnerability"),
    (["network"], "Network communication detected"),
    (["secret", "key"], "Potential secrets or keys exposed"),
    (["license"], "License compliance issue"),
    (["blacklist"], "Blacklisted model name detected"),
]
TAGS = [(["pickle"], ["pickle", "deserialization"]), (["import", "exec", "eval"], ["code-execution"]), (["network"], ["network"]), (["secret", "key"], ["secrets"]), (["license"], ["license"]), (["cve"], ["vulnerability"])]


def _has(text: Column, words: list[str]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def level(severity: Column) -> Column:
    """The SARIF level of a severity."""
    return F.when(severity == "critical", "error").when(severity == "info", "note").when(severity == "debug", "none").otherwise("warning")


def sarif_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 90.0).when(severity == "warning", 60.0).when(severity == "info", 30.0).when(severity == "debug", 10.0).otherwise(50.0)


def rule_id(kind: Column, message: Column, prefix: str = PREFIX) -> Column:
    """The id of an issue's rule: of its type, else of the beginning of its message."""
    base = F.upper(F.replace(F.replace(F.left(message, F.lit(30)), F.lit(" "), F.lit("-")), F.lit(":"), F.lit("")))
    named = F.coalesce(kind, F.lit("")) != ""
    return F.when(named, F.concat(F.lit(prefix), F.upper(F.replace(kind, F.lit(" "), F.lit("-"))))).otherwise(F.concat(F.lit(f"{prefix}-"), F.regexp_replace(base, r"[^\p{L}\p{N}-]", "")))


def rule_name(kind: Column, message: Column) -> Column:
    of_message = F.when(F.contains(message, F.lit(":")), F.substring_index(message, ":", 1)).otherwise(F.left(message, F.lit(50)))
    return F.when(F.coalesce(kind, F.lit("")) != "", F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))).otherwise(of_message)


def description(message: Column) -> Column:
    low, out = F.lower(message), F
    for words, text in DESCRIPTIONS:
        out = out.when(_has(low, words), F.lit(text))
    return out.otherwise(F.left(message, F.lit(100)))


def tags(message: Column) -> Column:
    low = F.lower(message)
    more = [F.when(_has(low, words), F.array(*[F.lit(t) for t in names])).otherwise(F.expr("cast(array() as array<string>)")) for words, names in TAGS]
    return F.concat(F.array(F.lit("security"), F.lit("ml-model")), *more)


def uri(path: Column) -> Column:
    """A path for a URI: all but slashes and unreserved signs percent-encoded."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def fingerprint(message: Column, location: Column, severity: Column) -> Column:
    return F.left(F.sha2(F.concat(message, F.coalesce(location, F.lit("")), severity).cast("binary"), 256), F.lit(16))


def _typed(issues: DataFrame, prefix: str) -> DataFrame:
    kind = F.col("type") if "type" in issues.columns else F.lit(None).cast("string")
    why = F.col("why") if "why" in issues.columns else F.lit(None).cast("string")
    return issues.withColumns({"kind_": kind, "why_": why, "rule_id": rule_id(kind, F.col("message"), prefix)})


def sarif_rules(issues: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """seq, rule_id, name, short, full, level, rank, tags: each rule once, by its first issue."""
    rows = _typed(issues, prefix)
    first = rows.groupBy("rule_id").agg(F.min("seq").alias("seq"), *[F.min_by(c, "seq").alias(c) for c in ("kind_", "message", "severity", "why_")])
    full = F.concat_ws(" ", description(F.col("message")), "why_")
    return first.select("seq", "rule_id", rule_name(F.col("kind_"), F.col("message")).alias("name"), description(F.col("message")).alias("short"), full.alias("full"), level(F.col("severity")).alias("level"), sarif_rank(F.col("severity")).alias("rank"), tags(F.col("message")).alias("tags"))


def sarif_results(issues: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """seq, rule_id, level, rank, kind, message, uri, fingerprint of each issue.

    A result names its rule by id. An index into the rules, which some give, would
    have to number all rules; readers take the id.
    """
    rows = _typed(issues, prefix)
    kind = F.when(F.col("severity").isin("critical", "warning"), "fail").otherwise("informational")
    return rows.select("seq", "rule_id", level(F.col("severity")).alias("level"), sarif_rank(F.col("severity")).alias("rank"), kind.alias("kind"), "message", uri(F.col("location")).alias("uri"), fingerprint(F.col("message"), F.col("location"), F.col("severity")).alias("fingerprint"))


def _section(number: int, rows: DataFrame, order: str, value: Column) -> DataFrame:
    """Lines of one array: every one but that of the least order begins with a comma."""
    least = rows.agg(F.min(order)).first()[0]
    return rows.select(F.lit(number).alias("section"), F.col(order).cast("string").alias("place"), F.concat(F.when(F.col(order) == F.lit(least), "").otherwise(","), F.to_json(value)).alias("line"))


def _lines(spark, texts: list[tuple[int, str]]) -> DataFrame:
    return spark.createDataFrame([(n, "", t) for n, t in texts], "section int, place string, line string")


def sarif_lines(issues: DataFrame, assets: DataFrame, summary: dict, tool: str = "sluicework", version: str = "1.0", prefix: str = PREFIX) -> DataFrame:
    """section, place, line: a SARIF 2.1.0 document. issues: seq, message, severity, location; assets: path, type, length, sha256."""
    rules = sarif_rules(issues, prefix).withColumn("order_", F.lpad(F.col("seq").cast("string"), 20, "0"))
    config = F.struct(F.lit(True).alias("enabled"), "level", "rank")
    rule = F.struct(F.col("rule_id").alias("id"), "name", F.struct(F.col("short").alias("text")).alias("shortDescription"), F.struct(F.col("full").alias("text")).alias("fullDescription"), config.alias("defaultConfiguration"), F.struct("tags", F.lit("high").alias("precision")).alias("properties"))
    results = sarif_results(issues, prefix).withColumn("order_", F.lpad(F.col("seq").cast("string"), 20, "0"))
    place = F.struct(F.struct(F.struct("uri", F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"))
    locations = F.when(F.coalesce("uri", F.lit("")) != "", F.array(place)).otherwise(F.array().cast(f"array<{place_type}>"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), locations.alias("locations"), F.struct(F.col("fingerprint").alias("primaryLocationLineHash")).alias("partialFingerprints"), F.lit("new").alias("baselineState"), "rank", "kind")
    files = assets.withColumn("uri_", uri(F.col("path")))
    artifact = F.struct(F.struct(F.col("uri_").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("location"), K.media_type(F.col("type")).alias("mimeType"), "length", F.struct(F.col("sha256").alias("sha-256")).alias("hashes"))
    head = {"$schema": SCHEMA, "version": "2.1.0"}
    properties = {k: v for k, v in summary.items() if k.endswith("_checks")}
    fixed = [
        (0, json.dumps(head)[:-1] + f', "runs": [{{"tool": {{"driver": {{"name": {json.dumps(tool)}, "version": {json.dumps(version)}, "language": "en-US", "rules": ['),
        (2, f']}}}}, "invocations": [{json.dumps({"executionSuccessful": not summary.get("has_errors", False), "exitCode": summary.get("exit_code", 0), "properties": {"filesScanned": summary.get("files_scanned", 0), "bytesScanned": summary.get("bytes_scanned", 0)}})}], "results": ['),
        (4, '], "artifacts": ['),
        (6, f'], "properties": {json.dumps(properties)}}}]}}'),
    ]
    out = _lines(issues.sparkSession, fixed)
    return out.union(_section(1, rules, "order_", rule)).union(_section(3, results, "order_", result)).union(_section(5, files, "path", artifact))


place_type = "struct<physicalLocation:struct<artifactLocation:struct<uri:string,uriBaseId:string>>>"


def write_lines(lines: DataFrame, path: str) -> None:
    """One file of the lines in order."""
    lines.orderBy("section", "place").select("line").coalesce(1).write.mode("overwrite").text(path)


def components(files: DataFrame, issues: DataFrame) -> DataFrame:
    """path, type, size, sha256, risk, properties (JSON): one CycloneDX component a file. files: path, size, perhaps sha256, licenses (array), is_model; issues: asset, severity."""
    weight = F.when(F.col("severity") == "critical", 5).when(F.col("severity") == "warning", 2).when(F.col("severity") == "info", 1).otherwise(0)
    risk = issues.groupBy(F.col("asset").alias("of")).agg(F.least(F.sum(weight), F.lit(10)).alias("risk"))
    out = files.join(risk, F.col("path") == F.col("of"), "left").drop("of").withColumn("risk", F.coalesce("risk", F.lit(0)))
    kind = K.component_type(F.col("path"), F.col("is_model") if "is_model" in files.columns else None)
    return out.withColumns({"type": kind, "properties": F.to_json(F.struct("size", "risk"))})


def license_expression(ids: Column) -> Column:
    """Distinct licence ids in their order, joined by OR; null for none."""
    return F.when(F.size(ids) > 0, F.array_join(F.array_distinct(ids), " OR "))


def sbom_lines(files: DataFrame, issues: DataFrame, serial: str = "urn:uuid:00000000-0000-0000-0000-000000000000") -> DataFrame:
    """section, place, line: a CycloneDX 1.6 document with a component a file, its hash, licences and risk."""
    made = components(files, issues)
    ids = F.col("licenses") if "licenses" in files.columns else F.expr("cast(array() as array<string>)")
    expression = license_expression(ids)
    hash_ = F.struct(F.lit("SHA-256").alias("alg"), F.col("sha256").alias("content"))
    one = lambda k, v: F.struct(F.lit(k).alias("name"), v.cast("string").alias("value"))
    component = F.struct(
        "type",
        K.file_name(F.col("path")).alias("name"),
        F.col("path").alias("bom-ref"),
        F.array(hash_).alias("hashes"),
        F.when(expression.isNotNull(), F.array(F.struct(expression.alias("expression")))).alias("licenses"),
        F.array(one("size", F.col("size")), one("risk_score", F.col("risk")), one("security:scanned", F.lit("true"))).alias("properties"),
    )
    head = {"bomFormat": "CycloneDX", "specVersion": "1.6", "serialNumber": serial, "version": 1}
    return _lines(files.sparkSession, [(0, json.dumps(head)[:-1] + ', "components": ['), (2, "]}")]).union(_section(1, made, "path", component))


def report_lines(checks: DataFrame, issues: DataFrame, summary: dict, types: int = 5) -> DataFrame:
    """section, place, line: the text report: totals, the first failed types of checks, issues by severity and order."""
    failed = checks.where("status = 'failed'").groupBy("name").agg(F.min("seq").alias("first"), F.count("*").alias("n")).orderBy("first")
    first = failed.limit(types + 1).collect()
    more = failed.count() - types if len(first) > types else 0
    shown = ", ".join(f"{r['name']} ({r['n']})" for r in first[:types]) + (f" and {more} more" if more else "")
    by = {r.severity: r["count"] for r in issues.groupBy("severity").count().collect()}
    top = [(0, f"Files: {summary.get('files_scanned', 0)}, bytes: {summary.get('bytes_scanned', 0)}"), (1, "Failed checks: " + (shown or "none")), (2, ", ".join(f"{s}: {by.get(s, 0)}" for s in reversed(SEVERITIES)))]
    place = F.concat(F.lpad((3 - F.coalesce(rank(F.col("severity")), F.lit(3))).cast("string"), 2, "0"), F.lpad(F.col("seq").cast("string"), 20, "0"))
    line = F.concat_ws(" ", F.concat(F.lit("["), F.upper("severity"), F.lit("]")), "location", "message")
    return _lines(checks.sparkSession, top).union(issues.select(F.lit(3).alias("section"), place.alias("place"), line.alias("line")))


def write_json(issues: DataFrame, path: str, verbose: bool = False) -> None:
    """JSON lines without debug rows unless verbose."""
    (issues if verbose else issues.where(~F.col("severity").eqNullSafe("debug"))).write.mode("overwrite").json(path)


def write_progress(progress: DataFrame, path: str) -> None:
    """Progress rows as CSV with a header, added to what is there."""
    progress.write.mode("append").option("header", "true").csv(path)
