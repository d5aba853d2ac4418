"""Queries of configuration, templates, code and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions import config as C
from ..functions import tables as T
from .data import CHECKS, DOCS, any_sql, checks, found_sql, payload_docs, quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_s, _any = quoted, any_sql
_HASHES = "CASE doc_id % 5 WHEN 0 THEN md5(text) WHEN 1 THEN sha256(text) WHEN 2 THEN left(sha256(text), 40) WHEN 3 THEN 'none' ELSE sha256(text) || sha256(text) END"


@_add(f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Weights_MD5' WHEN doc_id % 3 = 1 THEN 'title' ELSE 'file.checksum' END AS key, {_HASHES} AS value FROM documents)
SELECT doc_id, CASE len(value) WHEN 32 THEN 'MD5' WHEN 40 THEN 'SHA1' WHEN 64 THEN 'SHA256' WHEN 128 THEN 'SHA512' END AS algorithm, len(value) IN (32, 40) AS is_weak FROM p
WHERE key <> 'title' AND len(value) IN (32, 40, 64, 128)""")
def weak_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, sha = F.col("doc_id"), F.sha2("text", 256)
    value = F.when(i % 5 == 0, F.md5("text")).when(i % 5 == 1, sha).when(i % 5 == 2, F.left(sha, F.lit(40))).when(i % 5 == 3, "none").otherwise(F.concat(sha, sha))
    key = F.when(i % 3 == 0, "Weights_MD5").when(i % 3 == 1, "title").otherwise("file.checksum")
    return C.weak_hashes(table(spark, sf_dir, "documents").select("doc_id", key.alias("key"), value.alias("value")), "key", "value").select("doc_id", "algorithm", "is_weak")


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of the pages; some are moved under trusted and suspicious domains."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    moved = F.when(F.col("page_id") % 5 == 0, F.concat(host, F.lit(".huggingface.co"))).when(F.col("page_id") % 5 == 1, "bit.ly").when(F.col("page_id") % 5 == 2, F.concat(F.lit("a"), F.lit("pytorch.org"))).otherwise(host)
    return table(spark, sf_dir, "pages").select("page_id", moved.alias("host"))


_HOSTS = "h AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN host || '.huggingface.co' WHEN 1 THEN 'bit.ly' WHEN 2 THEN 'apytorch.org' ELSE host END AS host FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages))"


def _under(domains) -> str:
    return "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in domains) + ")"


@_add(f"WITH {_HOSTS} SELECT page_id, host FROM h WHERE NOT {_under(T.TRUSTED)}")
def untrusted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.untrusted_hosts(_hosts(spark, sf_dir), "host", spark.createDataFrame([(d,) for d in T.TRUSTED], "domain string"))


@_add(f"WITH {_HOSTS} SELECT page_id, host FROM h WHERE {_under(T.SUSPICIOUS_DOMAINS)}")
def shortened_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.suspicious_hosts(_hosts(spark, sf_dir), "host")


@_add("""WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, key_path, value FROM e CROSS JOIN LATERAL (VALUES ('a.k', k), ('a.l[0]', '1.50'), ('a.l[1].z', 'y'), ('b', 'true'), ('c', NULL), ('d.e.f.g.h[0][0].i', k)) t(key_path, value)""")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    config = F.concat(F.lit('{"a": {"k": "'), k, F.lit('", "l": [1.50, {"z": "y"}]}, "b": true, "c": null, "d": {"e": {"f": {"g": {"h": [[{"i": "'), k, F.lit('"}]]}}}}, "empty": {}}'))
    return C.json_walk(table(spark, sf_dir, "events").select("event_id", config.alias("config")), "config", "event_id")


@_add("""SELECT doc_id, lang AS model_type, n_chars::VARCHAR AS vocab_size, '4.1' AS framework_version, CASE doc_id % 4 WHEN 0 THEN 'mit' WHEN 1 THEN source END AS license FROM documents""")
def config_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    license_ = F.when(i % 4 == 0, ', "license": "mit"').when(i % 4 == 1, F.concat(F.lit(', "licence": ["'), "source", F.lit('", "x"]'))).otherwise("")
    text = F.concat(F.lit('{"model_type": "'), "lang", F.lit('", "vocab_size": '), F.col("n_chars").cast("string"), F.lit(', "transformers_version": "4.1"'), license_, F.lit("}"))
    facts = C.model_facts(F.col("config"))
    return table(spark, sf_dir, "documents").withColumn("config", text).select("doc_id", *[facts[k].alias(k) for k in ("model_type", "vocab_size", "framework_version", "license")])


_NOTES = "CASE doc_id % 4 WHEN 0 THEN '# ' || replace(text, chr(10), chr(10) || '  # ') WHEN 1 THEN 'note: a' || chr(13) || text || chr(10) || 'warning: b' ELSE text END"


@_add(f"""WITH t AS (SELECT doc_id, unnest(string_split_regex({_NOTES}, {_s(C.LINE_ENDS)})) AS line FROM documents),
l AS (SELECT doc_id, regexp_replace(line, '^[\\s\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x1F]+', '') AS line FROM t)
SELECT doc_id FROM l WHERE line <> '' GROUP BY doc_id HAVING 2 * count(*) FILTER (starts_with(line, '#') OR starts_with(line, repeat(chr(34), 3)) OR starts_with(line, repeat(chr(39), 3)) OR starts_with(line, 'warning:') OR starts_with(line, 'note:')) > count(*)""")
def documentation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, text = F.col("doc_id"), F.col("text")
    noted = F.when(i % 4 == 0, F.concat(F.lit("# "), F.replace(text, F.lit("\n"), F.lit("\n  # ")))).when(i % 4 == 1, F.concat(F.lit("note: a\r"), text, F.lit("\nwarning: b"))).otherwise(text)
    return table(spark, sf_dir, "documents").where(C.mostly_documentation(noted)).select("doc_id")


_TEMPLATES = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, '{C.TEMPLATE_RISK[k]}' AS risk, doc_id, len(regexp_extract_all(text, {_s('(?i)' + p.replace('{%', chr(92) + '{%').replace('%}', '%' + chr(92) + '}'))})) AS n FROM docs"
    for k, patterns in T.TEMPLATE_PATTERNS.items()
    for p in patterns
)


@_add(f"WITH {DOCS}, f AS ({_TEMPLATES}) SELECT kind, risk, CASE risk WHEN 'CRITICAL' THEN 'critical' ELSE 'warning' END AS severity, sum(n)::BIGINT AS n, count(DISTINCT doc_id) AS n_files FROM f WHERE n > 0 GROUP BY kind, risk")
def template_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payload_docs(spark, sf_dir).select("doc_id", F.explode(C.template_findings(F.col("text"))).alias("f")).select("doc_id", "f.*")
    return found.groupBy("kind", "risk", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_files"))


@_add(f"WITH {DOCS} SELECT doc_id FROM docs WHERE len(text) >= 5 AND {_any('text', ['{{', '{%', '{#'])}")
def template_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_docs(spark, sf_dir).where(C.is_template(F.col("text"))).select("doc_id")


_PLAIN = "regexp_replace(content, '\\x{FFFD}', '', 'g')"
_PARTS = f"""parts AS (SELECT doc_id, 'original' AS encoding, text FROM docs
 UNION ALL SELECT doc_id, 'deobfuscated_base64_encoded', try(decode(from_base64(x))) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/]{{20,}}={{0,2}}')) AS x FROM docs) WHERE len(x) % 4 = 0
 UNION ALL SELECT doc_id, 'deobfuscated_hex_encoded', try(decode(unhex(replace(x, '\\x', '')))) FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:\\\\x[0-9a-fA-F]{{2}})+')) AS x FROM docs) WHERE len(x) >= 8
 UNION ALL SELECT doc_id, 'deobfuscated_string_concat', array_to_string(regexp_extract_all(x, '["'']([^"'']*)["'']', 1), '') FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_s(T.ENCODINGS[3][1])})) AS x FROM docs) WHERE len(x) >= 10),
files AS (SELECT * FROM parts WHERE encoding = 'original' OR len(text) > 3)"""
_AROUND = "substring(text, greatest(position - 100, 0) + 1, least(position, 100) + len(value) + 100)"
_CODE = " UNION ALL ".join(f"SELECT *, '{k}' AS kind, '{s}' AS severity, '{c}' AS category FROM {found_sql('(?i)' + p, keep='doc_id, encoding, text')}" for k, s, c, patterns in T.CODE_PATTERNS for p in patterns)
_RANKED = f"""f AS (SELECT *, {_AROUND} AS near FROM ({_CODE})), r AS (SELECT doc_id, encoding, kind, severity, category, value AS match, position, round(greatest(least(0.7 + CASE WHEN ends_with(value, '(') THEN 0.1 ELSE 0 END
 + CASE WHEN encoding <> 'original' THEN 0.2 ELSE 0 END - CASE WHEN contains(near, '#') OR contains(near, '//') THEN 0.2 ELSE 0 END - CASE WHEN {_any('lower(near)', C.NOTE_WORDS)} THEN 0.3 ELSE 0 END
 + CASE WHEN {_any('near', C.ARGUMENTS)} THEN 0.15 ELSE 0 END, 1), 0.1), 6)::DOUBLE AS confidence FROM f)"""


@_add(f"WITH {DOCS}, {_PARTS}, {_RANKED} SELECT * FROM r")
def code_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.code_findings(payload_docs(spark, sf_dir), "text", "doc_id").withColumn("confidence", F.round("confidence", 6))


@_add(f"""WITH {DOCS}, {_PARTS}, {_RANKED} SELECT doc_id, kind, match, severity, confidence FROM r ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, confidence DESC, doc_id, encoding, position, kind, match LIMIT 30""")
def code_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 findings by severity, then confidence."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return code_patterns(spark, sf_dir).orderBy(rank, F.desc("confidence"), "doc_id", "encoding", "position", "kind", "match").limit(30).select("doc_id", "kind", "match", "severity", "confidence")


_SCRIPTS = [f"SELECT doc_id, 'dangerous_operation' AS kind, 'CRITICAL' AS severity, {c}::DOUBLE AS confidence, {_s(op)} AS value FROM docs WHERE contains(text, {_s(op)})" for ops, c in ((T.TORCH_OPS, 1.0), (T.TF_FUNCTIONS, 0.9)) for op in ops]
_SCRIPTS += [
    f"SELECT doc_id, '{k}', '{s}', {c}::DOUBLE, '{v}' FROM docs WHERE {test}"
    for k, s, c, v, test in (
        ("embedded_pickle", "WARNING", 0.9, "GLOBAL", "contains(text, 'GLOBAL') AND contains(text, 'torch')"),
        ("py_func_usage", "CRITICAL", 0.9, "py_func", "(contains(text, 'SavedFunction') OR contains(text, 'saved_model.pb')) AND (contains(text, 'py_func') OR contains(text, 'numpy_function'))"),
        ("lambda_layer", "WARNING", 0.8, "Lambda", "contains(text, 'Lambda') AND contains(text, 'keras')"),
        ("custom_operator", "WARNING", 0.7, "custom_op", "contains(text, 'custom_op') OR contains(text, 'ai.onnx.contrib')"),
        ("python_operator", "CRITICAL", 0.9, "PythonOp", "contains(text, 'PythonOp') OR contains(text, 'PyOp')"),
        ("function_extension", "INFO", 0.5, "onnx.function", "contains(text, 'onnx.function')"),
    )
]
_SCRIPTS += [f"SELECT doc_id, 'torchscript_{k}', 'CRITICAL', 0.9::DOUBLE, {_s(p)} FROM docs WHERE regexp_matches(text, {_s('(?i)' + p)})" for k, patterns in T.SCRIPT_PATTERNS.items() for p in patterns]


@_add(f"WITH {DOCS}, f AS ({' UNION ALL '.join(_SCRIPTS)}) SELECT kind, severity, confidence, value, count(*) AS n FROM f GROUP BY ALL")
def script_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payload_docs(spark, sf_dir).select(F.explode(C.script_findings(F.col("text"))).alias("f")).select("f.*")
    return found.groupBy("kind", "severity", "confidence", "value").agg(F.count("*").alias("n"))


def _groups(groups: list[list[str]]) -> str:
    return "(" + " AND ".join(_any("low", g) for g in groups) + ")"


_CVE = [
    f"SELECT doc_id, '{cve}' AS cve, {cvss}::DOUBLE AS cvss, '{cwe}' AS cwe, 1 + " + " + ".join([f"{_groups(g)}::INT" for g in more] + [f"contains(text, {_s(w)})::INT" for w in plain]) + f" AS n FROM l WHERE {_groups(needed)}"
    for cve, cvss, cwe, needed, more, plain in C.CVES
]
_TWO = "(" + " + ".join(f"contains(low, {_s(w)})::INT" for w in C.MISMATCH_WORDS) + ") >= 2"
_CVE.append(
    f"SELECT doc_id, '{C.TENSOR_CVE[0]}', {C.TENSOR_CVE[1]}::DOUBLE, '{C.TENSOR_CVE[2]}', 1 + " + " + ".join(f"contains(text, {_s(w)})::INT" for w in C.TENSOR_AS_IS)
    + f" + ({_any('low', C.ITEM_WORDS)} AND {_any('low', C.STORAGE_WORDS)})::INT FROM l WHERE {_any('low', C.TENSOR_WORDS)} AND ({_any('low', C.ITEM_WORDS)} OR {_TWO} OR {_any('low', C.STORAGE_WORDS)})"
)
_CVE = f"l AS (SELECT *, lower(text) AS low FROM docs), c AS (SELECT doc_id, cve, cvss, cwe, round(least(1, 0.7 + 0.1 * n), 6)::DOUBLE AS confidence FROM ({' UNION ALL '.join(_CVE)}))"


@_add(f"WITH {DOCS}, {_CVE} SELECT * FROM c")
def cve_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cve_indicators(payload_docs(spark, sf_dir), "text", "doc_id").withColumn("confidence", F.round("confidence", 6))


@_add(f"WITH {DOCS}, {_CVE} SELECT doc_id, round(least(max(cvss / 10 * confidence), 1), 6) AS risk FROM c GROUP BY doc_id")
def cve_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cve_risk(C.cve_indicators(payload_docs(spark, sf_dir), "text", "doc_id"), "doc_id").withColumn("risk", F.round("risk", 6))


_SNIPPETS = [
    "import os\nos.system('id')",
    "eval('1 + 2')",
    "x = 1\nreturn x",
    "import os\nprint(os.path.join('a', 'b'))",
    "f = lambda *a, **k: exec(a[0])\nopen('x', 'w')",
    "this is no code",
    "import subprocess, socket\nsubprocess.Popen(['ls'])\nsocket.socket()",
    "__import__('os').system('id')",
]
#: By hand from the rules: is_code, risk, level, score, dangerous.
_EXPECTED = """('true', 10, 'medium', 2.0, 'os\\.system\\s*\\('), ('true', 10, 'safe', -0.5, 'eval\\s*\\('), ('false', 0, 'safe', 0.0, NULL), ('true', 2, 'safe', -0.5, NULL),
 ('true', 23, 'low', 1.0, 'exec\\s*\\('), ('false', 0, 'medium', NULL, NULL), ('true', 17, 'medium', 2.0, 'subprocess\\.'), ('true', 10, 'low', 1.0, '__import__\\s*\\(')"""


@_add(f"""WITH t AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {_EXPECTED}) v(is_code, risk, level, score, dangerous))
SELECT doc_id, is_code::BOOLEAN AS is_code, risk::BIGINT AS risk, level, score::DOUBLE AS score, dangerous FROM documents JOIN t ON doc_id % {len(_SNIPPETS)} = k""")
def code_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    snippet = F.element_at(F.array(*[F.lit(x) for x in _SNIPPETS]), (F.col("doc_id") % len(_SNIPPETS) + 1).cast("int"))
    return code.analysed(table(spark, sf_dir, "documents").select("doc_id", snippet.alias("code")), "code", "doc_id")


_SIGNS = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS sign FROM docs WHERE regexp_matches(text, {_s(p)})" for k, p in code.OBFUSCATION)


@_add(f"WITH {DOCS} {_SIGNS}")
def obfuscation_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload_docs(spark, sf_dir).select("doc_id", F.explode(code.obfuscation(F.col("text"))).alias("sign"))


@_add(f"""WITH {CHECKS}, m AS (SELECT seq, severity, CASE seq % 9 WHEN 0 THEN 'Permission denied: ' WHEN 1 THEN 'permission denied: ' WHEN 2 THEN 'Scan timeout' ELSE '' END || message AS message FROM checks WHERE status = 'failed')
SELECT count(*) FILTER ({_any('message', T.ERRORS)} AND severity IN ('warning', 'critical')) AS n_errors, count(*) AS n FROM m""")
def operational_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seq") % 9
    before = F.when(i == 0, "Permission denied: ").when(i == 1, "permission denied: ").when(i == 2, "Scan timeout").otherwise("")
    m = checks(spark, sf_dir).where("status = 'failed'").withColumn("message", F.concat(before, "message"))
    return m.agg(F.count_if(C.operational_error(F.col("message"), F.col("severity"))).alias("n_errors"), F.count("*").alias("n"))


_META_KEYS = ["path", "license", "risk_level", "Suspicious_thing", "imports", "author"]


@_add(f"""WITH m AS (SELECT doc_id, unnest([{', '.join(map(_s, _META_KEYS))}]) AS key, source AS value FROM documents)
SELECT doc_id, key, value FROM m WHERE key IN ({', '.join(map(_s, T.SECURITY_KEYS))}) OR {_any('lower(key)', C.SECURITY_WORDS)}""")
def security_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    metadata = F.create_map(*[x for k in _META_KEYS for x in (F.lit(k), F.col("source"))])
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(C.security_metadata(metadata)).alias("key", "value"))


@_add("SELECT s_name, 'supplier#00000001' AS policy_word FROM supplier WHERE contains(lower(s_name), 'supplier#00000001')")
def blacklisted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.name_hits(table(spark, sf_dir, "supplier").select("s_name"), "s_name", ["SUPPLIER#00000001", "nothing like it"])


@_add("SELECT DISTINCT o_custkey AS missing FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def missing_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("missing")).distinct()
    there = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey")
    return refs.join(there, F.col("missing") == F.col("c_custkey"), "left_anti")


@_add("SELECT c_custkey AS id FROM customer WHERE c_custkey % 2 = 0 UNION SELECT s_suppkey FROM supplier")
def whitelist_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return even.union(table(spark, sf_dir, "supplier").select("s_suppkey")).distinct()


@_add(f"""WITH {CHECKS} SELECT rule_code, count(*) AS n FROM checks WHERE substring(rule_code, 2)::INT BETWEEN 102 AND 103 GROUP BY rule_code""")
def rule_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir).where(F.substring("rule_code", 2, 10).try_cast("int").between(102, 103)).groupBy("rule_code").agg(F.count("*").alias("n"))
