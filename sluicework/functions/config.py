"""Detectors of configuration, templates and code in text, and predicates on findings."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T
from .detect import any_of, around, found

#: CVEs with their score, weakness, and conditions on a text in lower case: words of which each group needs one, then what adds to the confidence:
#: groups of words in lower case (all groups of an entry needed), and words as they are.
CVES = [
    ("CVE-2020-13092", 9.8, "CWE-502", [["sklearn", "joblib"], ["os.system", "subprocess", "eval(", "exec("]], [[["joblib.load", "joblib.dump", "pickle.load"]], [["os.system"], ["subprocess"]]], ["os.system", "subprocess"]),
    ("CVE-2024-34997", 8.1, "CWE-502", [["numpyarraywrapper", "read_array", "numpy_pickle"], ["pickle.load", "os.system", "subprocess", "eval(", "exec("]], [[["joblib"]], [["pickle.load"], ["numpyarraywrapper"]]], ["NumpyArrayWrapper", "read_array", "os.system"]),
    ("CVE-2022-45907", 9.8, "CWE-94", [["parse_type_line", "torch.jit.annotations", "jit.annotations"], ["eval", "exec", "compile"]], [[["parse_type_line"], ["eval"]]], ["parse_type_line", "torch.jit.annotations", "eval"]),
    ("CVE-2024-5480", 10.0, "CWE-94", [["torch.distributed.rpc", "rpc_sync", "rpc_async", "pythonudf"], ["eval", "exec", "__import__", "os.system", "subprocess"]], [[["pythonudf"], ["eval", "exec"]]], ["torch.distributed.rpc", "rpc_sync", "PythonUDF", "rpc_async"]),
    ("CVE-2024-48063", 9.8, "CWE-502", [["remotemodule", "remote_module_pickled"], ["__reduce__", "pickle", "deserializ", "unpickl"]], [[["remotemodule"], ["__reduce__"]]], ["RemoteModule", "remote_module_pickled", "torch.distributed.rpc"]),
]
#: The one CVE with three ways in: tensor words, item operations, storage words, words of which two must be there; words as they are.
TENSOR_CVE = ("CVE-2026-24747", 8.8, "CWE-502")
TENSOR_WORDS = ["_rebuild_tensor", "torch._utils", "torch.storage", "floatstorage", "longstorage", "halfstorage", "bfloat16storage"]
ITEM_WORDS = ["setitem", "setitems"]
STORAGE_WORDS = ["storage_offset", "element_size", "numel"]
MISMATCH_WORDS = ["storage_size", "nbytes", "untyped_storage", "storage_offset"]
TENSOR_AS_IS = ["_rebuild_tensor", "SETITEM", "storage_offset", "torch._utils"]
#: Template findings: risk of a kind, parts of common chat templates.
TEMPLATE_RISK = {"critical_injection": "CRITICAL", "object_traversal": "HIGH", "global_access": "HIGH", "obfuscation": "HIGH", "control_flow": "MEDIUM", "environment_access": "MEDIUM"}
CHAT_PARTS = ["for message in messages", "message['role']", "message['content']", "messages[0]['role']", "if message['role'] == 'system'", "if message['role'] == 'user'", "if message['role'] == 'assistant'", "if message['role'] == 'tool'", "['role']", "['content']", "['tools']", "['name']", "for tool in tools", "if tool is not string"]
#: Words near a code pattern that lower its confidence, and arguments that raise it.
NOTE_WORDS = ["documentation", "comment", "note", "description", "does not use", "safe"]
ARGUMENTS = ["shell=True", "/bin/sh", "cmd.exe", "/c ", ";", "&&", "||"]
DOCUMENTATION = ["#", '"""', "'''", "warning:", "note:"]
SECURITY_WORDS = ["security", "suspicious", "dangerous", "malicious", "risk"]
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def weak_hashes(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """Pairs whose key names a hash, with algorithm and is_weak by the value's length."""
    named = any_of(F.lower(key), T.HASH_KEYS) & F.col(value).rlike("^[0-9a-fA-F]+$")
    n = F.length(value)
    algorithm = F.when(n == 32, "MD5").when(n == 40, "SHA1").when(n == 64, "SHA256").when(n == 128, "SHA512")
    return pairs.where(named).withColumn("algorithm", algorithm).where("algorithm is not null").withColumn("is_weak", F.col("algorithm").isin("MD5", "SHA1"))


def host_suffixes(host: Column) -> Column:
    """A host and all domains that it is under."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def untrusted_hosts(hosts: DataFrame, host: str, trusted: DataFrame) -> DataFrame:
    """Hosts that are neither trusted nor under a trusted domain: an equi-join on each suffix. trusted: domain."""
    each = hosts.select(F.col(host).alias("of_host")).distinct().withColumn("suffix", F.explode(host_suffixes(F.col("of_host"))))
    known = each.join(trusted, F.col("suffix") == F.col("domain"), "left_semi").select("of_host").distinct()
    return hosts.join(known, F.col(host) == F.col("of_host"), "left_anti")


def suspicious_hosts(hosts: DataFrame, host: str, domains: Sequence[str] = tuple(T.SUSPICIOUS_DOMAINS)) -> DataFrame:
    """Hosts that are or are under a domain of link shorteners and tunnels."""
    return hosts.where(F.exists(host_suffixes(F.col(host)), lambda s: s.isin(*domains)))


def _leaves(value, path: str):
    """(path, scalar as text) of a parsed value; an explicit stack, so depth is no limit but memory."""
    todo = [(path, value)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [(f"{path}.{k}" if path else k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        else:
            yield path, value if value is None or isinstance(value, str) else json.dumps(value)


class _Number(str):
    """A number as it is written."""


def json_walk(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, key_path, value: all scalar leaves of a JSON text, however deep, in one pass. What is no JSON is one leaf with an empty path."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            at, paths, values = [], [], []
            for i, value in enumerate(batch.column(0).to_pylist()):
                try:
                    found = list(_leaves(json.loads(value or "", parse_int=_Number, parse_float=_Number, parse_constant=_Number), ""))
                except (ValueError, RecursionError):
                    found = [("", value)]
                at += [i] * len(found)
                paths += [p for p, _ in found]
                values += [None if v is None else str(v) for _, v in found]
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns[1:]), pa.array(paths, pa.string()), pa.array(values, pa.string())], names=[*names, "key_path", "value"])

    own = rows.select(F.col(text).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)
    return own.mapInArrow(run, f"{schema}key_path string, value string").toDF(*keep, "key_path", "value")


def model_facts(text: Column) -> dict[str, Column]:
    """Facts of a model's configuration and its licence: a string, or the first of a list."""
    out = {name: F.get_json_object(text, f"$.{key}") for key, name in T.FACTS.items()}
    each = [F.coalesce(F.get_json_object(text, f"$.{k}[0]"), F.get_json_object(text, f"$.{k}")) for k in ("license", "licence", "licenses")]
    return {**out, "license": F.coalesce(*each)}


def mostly_documentation(text: Column) -> Column:
    """Whether more than half of the lines with text begin as comments, quotes or notes."""
    lines = F.filter(F.transform(F.split(text, LINE_ENDS), lambda x: F.regexp_replace(x, r"^[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x1F]+", "")), lambda x: x != "")
    notes = F.filter(lines, lambda x: F.rlike(x, F.lit("^(" + "|".join(DOCUMENTATION) + ")")))
    return F.size(notes) * 2 > F.size(lines)


def is_template(text: Column) -> Column:
    return (F.length(text) >= 5) & any_of(text, ["{{", "{%", "{#"])


def template_findings(text: Column, framework: str | None = None, confidence: int = 0) -> Column:
    """kind, match, risk, severity of every expression that reaches out of a template. In chat templates their common parts don't count."""

    def of(kind: str, pattern: str) -> Column:
        risk = TEMPLATE_RISK[kind]
        severity = "critical" if risk == "CRITICAL" else "info" if confidence >= 3 and framework == "huggingface" and kind in ("control_flow", "environment_access") else "warning"
        values = F.regexp_extract_all(text, F.lit(f"(?i){pattern}".replace("{%", r"\{%").replace("%}", r"%\}")), F.lit(0))
        if framework == "huggingface":
            values = F.filter(values, lambda m: ~any_of(F.replace(F.lower(m), F.lit('"'), F.lit("'")), CHAT_PARTS))
        return F.transform(values, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("match"), F.lit(risk).alias("risk"), F.lit(severity).alias("severity")))

    return F.concat(*[of(k, p) for k, patterns in T.TEMPLATE_PATTERNS.items() for p in patterns])


def decoded(text: Column) -> Column:
    """encoding, content: the text itself and what its encoded parts say. Bytes that are no UTF-8 are left out."""

    def said(data: Column) -> Column:
        return F.replace(F.make_valid_utf8(data.cast("string")), F.lit("�"), F.lit(""))

    decoders = {
        "base64_encoded": lambda x: F.when(F.length(x) % 4 == 0, said(F.unbase64(x))),
        "hex_encoded": lambda x: said(F.unhex(F.replace(x, F.lit("\\x"), F.lit("")))),
        "unicode_escape": lambda x: F.when(~x.rlike(r"(?i)\\ud[89a-f]"), F.decode(F.unhex(F.replace(x, F.lit("\\u"), F.lit(""))), "UTF-16BE")),
        "string_concat": lambda x: F.array_join(F.regexp_extract_all(x, F.lit("[\"']([^\"']*)[\"']"), F.lit(1)), ""),
    }

    def of(name: str, pattern: str, least: int) -> Column:
        values = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x) >= least)
        parts = F.transform(values, lambda x: F.struct(F.lit(f"deobfuscated_{name}").alias("encoding"), decoders[name](x).alias("content")))
        return F.filter(parts, lambda p: F.length(p["content"]) > 3)

    return F.concat(F.array(F.struct(F.lit("original").alias("encoding"), text.alias("content"))), *[of(*x) for x in T.ENCODINGS])


def code_findings(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, encoding, kind, severity, category, match, position, confidence: code patterns in texts and in what they encode."""
    parts = rows.select(*keep, F.explode(decoded(F.col(text))).alias("p")).select(*keep, "p.*")
    content = F.col("content")

    def of(kind: str, severity: str, category: str, pattern: str) -> Column:
        def one(m):
            near = around(content, m["position"], F.length(m["value"]), 100, 100)
            up = F.when(F.endswith(m["value"], F.lit("(")), 0.1).otherwise(0.0) + F.when(F.startswith("encoding", F.lit("deobfuscated")), 0.2).otherwise(0.0)
            down = F.when(any_of(near, ["#", "//"]), 0.2).otherwise(0.0) + F.when(any_of(F.lower(near), NOTE_WORDS), 0.3).otherwise(0.0)
            confidence = F.greatest(F.least(0.7 + up - down + F.when(any_of(near, ARGUMENTS), 0.15).otherwise(0.0), F.lit(1.0)), F.lit(0.1))
            return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), m["value"].alias("match"), m["position"].alias("position"), confidence.alias("confidence"))

        return F.transform(found(content, f"(?i){pattern}"), one)

    every = F.concat(*[of(k, s, c, p) for k, s, c, patterns in T.CODE_PATTERNS for p in patterns])
    return parts.select(*keep, "encoding", F.explode(every).alias("f")).select(*keep, "encoding", "f.*")


def script_findings(text: Column) -> Column:
    """kind, severity, confidence, value: dangerous operations of compiled graphs, their markers, and attacks on scripts."""

    def one(kind: str, severity: str, confidence: float, value: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(value).alias("value"))

    hits = [F.when(F.contains(text, F.lit(op)), one("dangerous_operation", "CRITICAL", 1.0, op)) for op in T.TORCH_OPS]
    hits += [F.when(F.contains(text, F.lit(op)), one("dangerous_operation", "CRITICAL", 0.9, op)) for op in T.TF_FUNCTIONS]
    both = lambda a, b: any_of(text, a) & any_of(text, b)
    hits += [
        F.when(both(["GLOBAL"], ["torch"]), one("embedded_pickle", "WARNING", 0.9, "GLOBAL")),
        F.when(both(["SavedFunction", "saved_model.pb"], ["py_func", "numpy_function"]), one("py_func_usage", "CRITICAL", 0.9, "py_func")),
        F.when(both(["Lambda"], ["keras"]), one("lambda_layer", "WARNING", 0.8, "Lambda")),
        F.when(any_of(text, ["custom_op", "ai.onnx.contrib"]), one("custom_operator", "WARNING", 0.7, "custom_op")),
        F.when(any_of(text, ["PythonOp", "PyOp"]), one("python_operator", "CRITICAL", 0.9, "PythonOp")),
        F.when(any_of(text, ["onnx.function"]), one("function_extension", "INFO", 0.5, "onnx.function")),
    ]
    for kind, patterns in T.SCRIPT_PATTERNS.items():
        hits += [F.when(text.rlike(f"(?i){p}"), one(f"torchscript_{kind}", "CRITICAL", 0.9, p)) for p in patterns]
    return F.array_compact(F.array(*hits))


def _all_groups(low: Column, groups: list[list[str]]) -> Column:
    hit = F.lit(True)
    for words in groups:
        hit = hit & any_of(low, words)
    return hit


def _count(conditions: list[Column]) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def cve_array(text: Column) -> Column:
    """cve, cvss, cwe, confidence of the weaknesses that a text, if it isn't mostly documentation, shows signs of."""
    low, hits = F.lower(text), []
    as_is = lambda words: [F.contains(text, F.lit(w)) for w in words]
    one = lambda cve, cvss, cwe, n: F.struct(F.lit(cve).alias("cve"), F.lit(cvss).alias("cvss"), F.lit(cwe).alias("cwe"), F.least(F.lit(1.0), 0.7 + 0.1 * n).alias("confidence"))
    for cve, cvss, cwe, needed, more, plain in CVES:
        n = 1 + _count([_all_groups(low, g) for g in more]) + _count(as_is(plain))
        hits.append(F.when(_all_groups(low, needed), one(cve, cvss, cwe, n)))
    item, storage = any_of(low, ITEM_WORDS), any_of(low, STORAGE_WORDS)
    mismatch = _count([F.contains(low, F.lit(w)) for w in MISMATCH_WORDS]) >= 2
    n = 1 + _count(as_is(TENSOR_AS_IS)) + F.when(item & storage, 1).otherwise(0)
    hits.append(F.when(any_of(low, TENSOR_WORDS) & (item | mismatch | storage), one(*TENSOR_CVE, n)))
    return F.when(mostly_documentation(text), F.array()).otherwise(F.array_compact(F.array(*hits)))


def cve_indicators(rows: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep, cve, cvss, cwe, confidence."""
    return rows.select(*keep, F.explode(cve_array(F.col(text))).alias("f")).select(*keep, "f.*")


def cve_risk(found: DataFrame, key: str) -> DataFrame:
    """key, risk: the greatest share of ten that a score, weighted by its confidence, makes."""
    return found.groupBy(key).agg(F.least(F.max(F.col("cvss") / 10 * F.col("confidence")), F.lit(1.0)).alias("risk"))


def operational_error(message: Column, severity: Column) -> Column:
    """Whether a finding says that the scan itself went wrong. Case counts."""
    return any_of(message, T.ERRORS) & F.coalesce(severity.isin("warning", "critical"), F.lit(False))


def security_metadata(metadata: Column) -> Column:
    """Of a map of metadata what matters for security."""
    return F.map_filter(metadata, lambda k, _: k.isin(*T.SECURITY_KEYS) | any_of(F.lower(k), SECURITY_WORDS))


def name_hits(rows: DataFrame, name: str, words: list[str]) -> DataFrame:
    """Rows with policy_word for each blacklisted word in their name, case aside: one expression, no join."""
    hit = [F.when(F.contains(F.lower(name), F.lit(w)), F.lit(w)) for w in sorted({w.lower() for w in words})]
    return rows.withColumn("policy_word", F.explode(F.array_compact(F.array(*hit))))
