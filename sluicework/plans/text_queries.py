"""Queries of the text detectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect as D
from ..functions import tables as T
from ..functions.rules import BUILT_IN, built_in, match_rules
from .data import DOCS, FILE_DOCS, any_sql, file_docs, found_sql, payload_docs, quoted, table

QUERIES, SQL = {}, {}
_s = quoted
BLACKLIST = ["Evil.Host.tk", "10.0.0.1"]


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


_COLUMNS = "type, severity, confidence, value"
_CONFIDENCE = f"""CASE WHEN {any_sql('lower(value)', D.URL_WORDS)} THEN 0.9 WHEN {any_sql('value', D.URL_PORTS)} THEN 0.8
 WHEN NOT (starts_with(value, 'http://') OR starts_with(value, 'https://')) THEN 0.7 ELSE 0.5 END"""


def _urls(found: str, keep: str) -> str:
    return f"SELECT {keep}, 'url_detected' AS type, CASE WHEN {_CONFIDENCE} > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, ({_CONFIDENCE})::DOUBLE AS confidence, value, position FROM {found}"


_URLS = _urls(found_sql(D.URL), "doc_id")
_CLOUD = " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(text, {_s('(?i)' + p)})) AS url, {i} AS ordinal, {_s(v)} AS provider FROM files" for i, (p, _, v) in enumerate(T.CLOUD))
_BAD = any_sql("lower(url)", D.CLOUD_WORDS)
_CLOUD = f"""SELECT doc_id, 'cloud_storage_url' AS type, CASE WHEN {_BAD} THEN 'WARNING' ELSE 'INFO' END AS severity, CASE WHEN {_BAD} THEN 0.95 ELSE 0.9 END::DOUBLE AS confidence,
 arg_min(provider, ordinal) || ' ' || url AS value, NULL::INT AS position FROM ({_CLOUD}) GROUP BY doc_id, url"""
_O = [f"try_cast(split_part(value, '.', {i}) AS INT)" for i in (1, 2, 3, 4)]
_PRIVATE = f"""({_O[0]} IN (0, 10, 127) OR ({_O[0]} = 172 AND {_O[1]} BETWEEN 16 AND 31) OR ({_O[0]} = 192 AND {_O[1]} = 168) OR ({_O[0]} = 169 AND {_O[1]} = 254)
 OR ({_O[0]} = 192 AND {_O[1]} = 0 AND {_O[2]} = 2) OR ({_O[0]} = 192 AND {_O[1]} = 0 AND {_O[2]} = 0 AND {_O[3]} NOT IN (9, 10)) OR ({_O[0]} = 198 AND {_O[1]} IN (18, 19))
 OR ({_O[0]} = 198 AND {_O[1]} = 51 AND {_O[2]} = 100) OR ({_O[0]} = 203 AND {_O[1]} = 0 AND {_O[2]} = 113) OR {_O[0]} >= 240)"""
_NEAR = "lower(substring(text, greatest(position - 20, 0) + 1, least(position, 20) + len(value) + 20))"
_IPV4 = f"""SELECT doc_id, 'ipv4_address' AS type, 'MEDIUM' AS severity, CASE WHEN {_PRIVATE} THEN 0.3 WHEN {_O[0]} = 100 AND {_O[1]} BETWEEN 64 AND 127 THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence, value, position
 FROM (SELECT *, {_NEAR} AS near FROM {found_sql(T.IPV4)}) WHERE NOT {any_sql('near', ['version', 'ver', 'v.', 'release', 'build'])}
 AND NOT ((contains(near, '"' || value || '"') OR contains(near, '''' || value || '''')) AND {' AND '.join(f'{o} < 100' for o in _O)})
 AND NOT (((contains(near, '[') AND contains(near, ']')) OR (contains(near, '{{') AND contains(near, '}}'))) AND {any_sql('near', ['.0', 'float', 'weight', 'bias'])})
 AND NOT regexp_matches(value, '(^|\\.)0[0-9]')"""
_IPV6 = f"SELECT doc_id, 'ipv6_address' AS type, 'MEDIUM' AS severity, 0.6::DOUBLE AS confidence, value, position FROM {found_sql(T.IPV6)}"
_EXPLICIT = " || ".join(f"regexp_extract_all(text, {_s('(?i)' + p)})" for p in D.EXPLICIT_DOMAINS)
_MODEL = any_sql("lower(path)", D.MODEL_ENDINGS)
_DOMAINS = f"""SELECT doc_id, 'domain' AS type, 'MEDIUM' AS severity, 0.8::DOUBLE AS confidence, value, NULL::INT AS position FROM (SELECT DISTINCT doc_id, lower(CASE WHEN contains(x, '://') THEN split_part(split_part(x, '://', 2), '/', 1) ELSE x END) AS value
 FROM (SELECT doc_id, unnest({_EXPLICIT}) AS x FROM files WHERE {_MODEL}))
 UNION ALL SELECT doc_id, 'domain_name', CASE WHEN c < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END, c, value, NULL FROM (SELECT *, CASE WHEN {any_sql('value', ['malware', 'evil', 'hack', 'exploit'])} THEN 0.9
 WHEN tld IN ({', '.join(map(_s, T.SUSPICIOUS_ENDINGS))}) THEN 0.7 ELSE 0.3 END::DOUBLE AS c FROM (SELECT DISTINCT doc_id, lower(x) AS value, split_part(lower(x), '.', -1) AS tld
 FROM (SELECT doc_id, unnest(regexp_extract_all(text, {_s(T.DOMAIN)})) AS x FROM files WHERE NOT {_MODEL}))
 WHERE tld IN ({', '.join(map(_s, T.DOMAIN_ENDINGS))}) AND NOT regexp_matches(value, '\\.(pkl|pt|h5|pb|onnx|json)$') AND value NOT IN ({', '.join(map(_s, D.FRAMEWORK_HOSTS))})
 AND NOT {any_sql('value', D.LAYER_WORDS)} AND NOT (len(value) - len(replace(value, '.', '')) = 1 AND len(split_part(value, '.', 1)) <= 2 AND len(tld) <= 2))"""
_LIBRARIES = " UNION ALL ".join(
    f"SELECT doc_id, 'network_library' AS type, '{'CRITICAL' if x in ('socket', 'paramiko', 'pycurl') else 'HIGH'}' AS severity, {0.8 if x in ('socket', 'paramiko', 'pycurl') else 0.7}::DOUBLE AS confidence, {_s(x)} AS value, NULL::INT AS position FROM files WHERE "
    + any_sql("text", [f"import {x}", f"from {x}", f"{x}.connect", f"{x}.request", f"{x}.__init__"])
    for x in T.LIBRARIES
)
_FUNCTIONS = " UNION ALL ".join(
    f"SELECT doc_id, 'network_function' AS type, '{'CRITICAL' if 'socket.connect' in x or 'requests.' in x else 'HIGH'}' AS severity, {0.8 if 'socket.connect' in x or 'requests.' in x else 0.6}::DOUBLE AS confidence,"
    f" {_s(x)} || ' ' || substring(text, greatest(i - 51, 0) + 1, least(i - 1, 50) + 100) AS value, (i - 1)::INT AS position FROM (SELECT *, strpos(text, {_s(x)}) AS i FROM files) WHERE i > 0"
    for x in T.NETWORK_FUNCTIONS
)
_CONTROL = " UNION ALL ".join(
    f"SELECT doc_id, 'cc_pattern' AS type, 'CRITICAL' AS severity, {0.95 if x in ('malware', 'backdoor', 'trojan', 'botnet') else 0.8}::DOUBLE AS confidence,"
    f" {_s(x)} || ' ' || substring(text, greatest(i - 31, 0) + 1, least(i - 1, 30) + {len(x) + 30}) AS value, (i - 1)::INT AS position FROM (SELECT *, strpos(lower(text), {_s(x)}) AS i FROM files) WHERE i > 0"
    for x in T.CONTROL_WORDS
)
_PORTS = f"""SELECT doc_id, 'suspicious_port' AS type, 'MEDIUM' AS severity, 0.6::DOUBLE AS confidence, p::VARCHAR AS value, NULL::INT AS position FROM files, (SELECT unnest([{', '.join(map(str, T.PORTS))}]) AS p)
 WHERE NOT {any_sql('lower(path)', D.PORT_MODEL_ENDINGS)} AND (contains(text, ':' || p) OR contains(text, 'port=' || p) OR contains(text, 'port ' || p) OR contains(text, 'PORT=' || p))"""
_WIDE = "substring(text, greatest(position - 100, 0) + 1, least(position, 100) + len(value) + 100)"
_EXPLICIT_NETWORK = " UNION ALL ".join(
    f"SELECT doc_id, 'explicit_network_pattern' AS type, 'CRITICAL' AS severity, 0.95::DOUBLE AS confidence, '{kind} ' || left(value, 200) AS value, NULL::INT AS position FROM {found_sql('(?i)' + p)}"
    f" WHERE {any_sql('lower(path)', D.PORT_MODEL_ENDINGS)} AND len(regexp_replace({_WIDE}, {_s(D.UNPRINTABLE)}, '', 'g')) > 0.7 * len({_WIDE})"
    for p, kind in T.EXPLICIT_NETWORK
)
_BLACKLIST = " UNION ALL ".join(f"SELECT doc_id, 'blacklisted_domain' AS type, 'CRITICAL' AS severity, 1::DOUBLE AS confidence, {_s(d.lower())} AS value, NULL::INT AS position FROM files WHERE contains(lower(text), {_s(d.lower())})" for d in BLACKLIST)
_NETWORK = [_URLS, _CLOUD, _IPV4, _IPV6, _DOMAINS, _LIBRARIES, _FUNCTIONS, _CONTROL, _PORTS, _EXPLICIT_NETWORK, _BLACKLIST]


def _sql(part: str, columns: str = "doc_id, severity, confidence, value") -> str:
    return f"WITH {FILE_DOCS}, f AS ({part}) SELECT {columns} FROM f"


def _one(spark: SparkSession, sf_dir: str, findings, *columns: str) -> DataFrame:
    return D.explode_findings(file_docs(spark, sf_dir), findings, "doc_id").select(*(columns or ("doc_id", "severity", "confidence", "value")))


@_add(_sql(_URLS, "doc_id, severity, confidence, value, position"))
def network_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.url_findings(F.col("text")), "doc_id", "severity", "confidence", "value", "position")


@_add(f"WITH files AS (SELECT page_id, url AS text FROM pages) {_urls(found_sql(D.URL, keep='page_id'), 'page_id').replace('url_detected', 'page')}")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.explode_findings(table(spark, sf_dir, "pages"), D.url_findings(F.col("url")), "page_id").select("page_id", F.lit("page").alias("type"), "severity", "confidence", "value", "position")


@_add(_sql(_CLOUD))
def cloud_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.cloud_findings(F.col("text")))


@_add(_sql(_IPV4, "doc_id, confidence, value, position"))
def network_ipv4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.ipv4_findings(F.col("text")), "doc_id", "confidence", "value", "position")


@_add(_sql(_IPV6, "doc_id, confidence, value, position"))
def network_ipv6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.ipv6_findings(F.col("text")), "doc_id", "confidence", "value", "position")


@_add(_sql(_DOMAINS, "doc_id, type, severity, confidence, value"))
def network_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.domain_findings(F.col("text"), F.col("path")), "doc_id", "type", "severity", "confidence", "value")


@_add(_sql(_LIBRARIES))
def network_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.library_findings(F.col("text")))


@_add(_sql(_FUNCTIONS))
def network_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.function_findings(F.col("text")))


@_add(_sql(_CONTROL))
def control_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.control_findings(F.col("text")))


@_add(_sql(_PORTS))
def network_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, F.when(~D.any_of(F.lower("path"), D.PORT_MODEL_ENDINGS), D.port_findings(F.col("text"))))


@_add(_sql(_EXPLICIT_NETWORK))
def explicit_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, F.when(D.any_of(F.lower("path"), D.PORT_MODEL_ENDINGS), D.explicit_findings(F.col("text"))))


@_add(_sql(_BLACKLIST))
def blacklisted_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.blacklist_findings(F.col("text"), BLACKLIST))


_UNION = " UNION ALL ".join(f"SELECT doc_id, type, severity, confidence, value FROM ({q})" for q in _NETWORK)


@_add(f"WITH {FILE_DOCS}, f AS ({_UNION}) SELECT type, severity, count(*) AS n, count(DISTINCT doc_id) AS n_files, round(max(confidence), 6) AS confidence FROM f GROUP BY type, severity")
def network_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _one(spark, sf_dir, D.network_array(F.col("text"), F.col("path"), BLACKLIST), "doc_id", "type", "severity", "confidence")
    return found.groupBy("type", "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_files"), F.round(F.max("confidence"), 6).alias("confidence"))


_SECRETS = " UNION ALL ".join(
    f"SELECT doc_id, m[k] AS match, g[k] AS secret, {_s(kind)} AS kind, {str(any(x in kind.lower() for x in D.KNOWN_SECRETS)).lower()} AS known FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM"
    f" (SELECT doc_id, regexp_extract_all(text, {_s('(?i)' + p)}) AS m, regexp_extract_all(text, {_s('(?i)' + p)}, {1 if '([' in p else 0}) AS g FROM files))"
    for p, kind in T.SECRETS
)
_SECRETS = f"""f AS ({_SECRETS}), g AS (SELECT doc_id, kind, known, CASE WHEN contains(match, 'Bearer') AND contains(match, ' ') THEN trim(regexp_extract(match, '^[^ ]* (.*)$', 1)) ELSE secret END AS secret FROM f
 WHERE NOT {any_sql('lower(match)', D.PLACEHOLDERS)}), h AS (SELECT row_number() OVER () AS r, * FROM g),
c AS (SELECT r, count(*) AS k FROM (SELECT r, unnest(string_split(secret, '')) AS ch FROM h) GROUP BY r, ch),
e AS (SELECT r, -sum(k / n * log2(k / n)) AS bits FROM (SELECT r, k, sum(k) OVER (PARTITION BY r) AS n FROM c) GROUP BY r)"""


@_add(f"WITH {FILE_DOCS}, {_SECRETS} SELECT doc_id, kind, len(secret)::INT AS length FROM h JOIN e USING (r) WHERE known OR (bits >= 4 AND len(secret) >= 16)")
def secrets_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _one(spark, sf_dir, D.secret_findings(F.col("text")), "doc_id", F.col("value").alias("kind"), F.col("position").alias("length"))


_HEAD = "array_to_string(string_split(text, chr(10))[1:50], chr(10))"
_LICENSES = " UNION ALL ".join(f"SELECT doc_id, source, {_s(k)} AS spdx_id, {str(free).lower()} AS commercial_allowed FROM docs WHERE regexp_matches({_HEAD}, {_s('(?im)' + p)})" for p, k, _, free in T.LICENSES)


@_add(f"WITH {DOCS} SELECT doc_id, spdx_id, commercial_allowed FROM ({_LICENSES})")
def license_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.licenses(payload_docs(spark, sf_dir), "text", "doc_id").select("doc_id", "spdx_id", "commercial_allowed")


_COPY = " UNION ALL ".join(
    f"SELECT doc_id, trim(unnest(regexp_extract_all(head, {_s('(?im)' + p)}, 1))) AS year, trim(unnest(regexp_extract_all(head, {_s('(?im)' + p)}, 2))) AS holder FROM (SELECT doc_id, {_HEAD} || chr(10) AS head FROM docs)"
    for p in T.COPYRIGHTS
)


@_add(f"WITH {DOCS} {_COPY}")
def copyright_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.copyrights(payload_docs(spark, sf_dir), "text", "doc_id")


_RULES = "CASE " + " ".join(f"WHEN regexp_matches(message, {_s('(?i)' + '|'.join(f'(?:{p})' for p in ps))}) THEN {_s(c)}" for c, _, ps in BUILT_IN) + " END"


@_add(f"WITH {DOCS}, m AS (SELECT unnest(string_split(text, chr(10))) AS message FROM docs) SELECT rule_code, count(*) AS n FROM (SELECT {_RULES} AS rule_code FROM m) GROUP BY rule_code")
def rule_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = payload_docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("message"))
    return match_rules(messages, built_in(spark)).groupBy("rule_code").agg(F.count("*").alias("n"))


_MAPPED = {"CRITICAL": "critical", "HIGH": "critical", "MEDIUM": "warning", "WARNING": "warning", "INFO": "info"}


@_add(f"""WITH {FILE_DOCS}, {_SECRETS}, a AS (SELECT 'INFO' AS severity FROM h JOIN e USING (r) WHERE known OR (bits >= 4 AND len(secret) >= 16) UNION ALL SELECT severity FROM ({_UNION}))
SELECT CASE severity {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _MAPPED.items())} END AS severity, count(*) AS n FROM a GROUP BY 1""")
def finding_severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    found = _one(spark, sf_dir, F.concat(D.secret_findings(text), D.network_array(text, F.col("path"), BLACKLIST)), "severity")
    mapped = F
    for k, v in _MAPPED.items():
        mapped = mapped.when(F.col("severity") == k, F.lit(v))
    return found.groupBy(mapped.alias("severity")).agg(F.count("*").alias("n"))
