"""Queries of verdicts on references, strings and rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import verdicts as V
from .data import DOCS, any_sql, payload_docs, quoted, table

QUERIES, SQL = {}, {}
_s = quoted


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _list(values) -> str:
    return "[" + ", ".join(map(_s, values)) + "]"


_MODULES = [*T.DANGEROUS_MODULES, *T.SUSPICIOUS_GLOBALS, "os.path", "pip._internal.cli.main_parser", "osx", "collections", "torch._utils", "sklearn.tree", "PEDRA_2020", "", " Builtins", "torch", "a.b-c", V.EXTENSION]
_NAMES = ["system", "eval", "set", "loads", "OrderedDict", "attrgetter", "_rebuild_tensor_v2", "Popen", "x", "getattr", "spawn", "execfile", "copy", "resolve_name", "b64decode", "FloatStorage", "CodeType"]
_REFS = f"refs AS (SELECT DISTINCT ({_list(_MODULES)})[(l_orderkey % {len(_MODULES)})::INT + 1] AS module, ({_list(_NAMES)})[(l_partkey % {len(_NAMES)})::INT + 1] AS name FROM lineitem)"


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, key: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col(key) % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(pick(_MODULES, "l_orderkey").alias("module"), pick(_NAMES, "l_partkey").alias("name")).distinct()


_WHOLE = [m for m, n in T.SUSPICIOUS_GLOBALS.items() if n == "*"]
_NAMED = [f"{m} {x}" for m, n in T.SUSPICIOUS_GLOBALS.items() if n != "*" for x in n]
_SAFE = f"list_contains({_list(V.SAFE_GLOBALS)}, module || ' ' || name)"
_DANGEROUS = f"""CASE WHEN module = '{V.EXTENSION}' OR list_contains({_list(T.DANGEROUS_FUNCTIONS)}, module || '.' || name) OR list_contains({_list(T.DANGEROUS_FUNCTIONS)}, name) THEN true
 WHEN len(list_filter({_list(T.DANGEROUS_MODULES)}, lambda m: module = m OR starts_with(module, m || '.'))) > 0 THEN NOT {_SAFE} WHEN {_SAFE} THEN false
 ELSE list_contains({_list(_WHOLE)}, module) OR list_contains({_list(_NAMED)}, module || ' ' || name)
 OR ((list_contains({_list(V.BUILTINS)}, module) OR list_contains({_list(V.NEAR_BUILTINS)}, lower(trim(module)))) AND list_contains({_list(V.RUNNING)}, name)) END"""
_PLAUSIBLE = "regexp_matches(module, '^[a-z_][a-z0-9_]*(\\.[a-z_][a-z0-9_]*)*$')"


@_add(f"WITH {_REFS} SELECT module, name, {_DANGEROUS} AS is_dangerous, {_SAFE} AS is_safe, {_PLAUSIBLE} AS is_plausible FROM refs")
def dangerous_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, n = F.col("module"), F.col("name")
    return _refs(spark, sf_dir).select("module", "name", V.dangerous_global(m, n).alias("is_dangerous"), V.is_safe(m, n).alias("is_safe"), V.plausible_module(m).alias("is_plausible"))


def _import_sql() -> str:
    case = lambda rows: " ".join(f"WHEN lower(module) IN ({', '.join(map(_s, names))}) THEN '{code}'" for code, names in rows)
    own = "WHEN lower(module) IN ('__builtin__', '__builtins__', 'builtins') THEN CASE WHEN lower(name) IN ('eval', 'exec', 'execfile') THEN 'S104' WHEN lower(name) = 'compile' THEN 'S105' WHEN lower(name) = '__import__' THEN 'S106' ELSE 'S115' END"
    return f"CASE {case(V._MODULES)} {own} END"


@_add(f"WITH {_REFS} SELECT module, name, {_import_sql()} AS rule_code FROM refs")
def import_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).select("module", "name", V.import_rule(F.col("module"), F.col("name")).alias("rule_code"))


_WORDS = sorted({w for rows in V.MAPPERS.values() for _, groups in rows for g in groups for w in g})
_MESSAGES = f"m AS (SELECT DISTINCT upper(({_list(_WORDS)})[(event_id % {len(_WORDS)})::INT + 1]) || ' and ' || ({_list(_WORDS)})[(user_id % {len(_WORDS)})::INT + 1] AS message FROM events)"


def _mapped_sql(*categories: str) -> str:
    cases = " ".join(f"WHEN {' AND '.join(any_sql('lower(message)', g) for g in groups)} THEN {_s(code) if code else 'NULL'}" for c in categories or V.MAPPERS for code, groups in V.MAPPERS[c])
    return f"CASE {cases} END"


@_add(f"WITH {_MESSAGES} SELECT message, {_mapped_sql()} AS rule_code, {_mapped_sql('network')} AS network, {_mapped_sql('secret')} AS secret, {_mapped_sql('model')} AS model FROM m")
def mapped_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, n = F.array(*[F.lit(w) for w in _WORDS]), len(_WORDS)
    at = lambda key: F.element_at(words, (F.col(key) % n + 1).cast("int"))
    m = table(spark, sf_dir, "events").select(F.concat(F.upper(at("event_id")), F.lit(" and "), at("user_id")).alias("message")).distinct()
    t = F.col("message")
    return m.select("message", V.mapped_rule(t).alias("rule_code"), *[V.mapped_rule(t, c).alias(c) for c in ("network", "secret", "model")])


_SEEN = ["torch._utils", "torch._utils._rebuild_tensor_v2", "collections", "collections.OrderedDict", "sklearn.tree", "numpy", "numpy.core.multiarray", "xgboost.core", "other.thing", "transformers", "torch", "numpy._core"]
_SEEN_SQL = f"r AS (SELECT user_id, ({_list(_SEEN)})[((event_id * 7 + user_id) % {len(_SEEN)})::INT + 1] AS ref, count(*) AS n, min(event_id) AS first FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL)"


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref = F.element_at(F.array(*[F.lit(x) for x in _SEEN]), ((F.col("event_id") * 7 + F.col("user_id")) % len(_SEEN) + 1).cast("int"))
    return table(spark, sf_dir, "events").where("event_type in ('click', 'error')").groupBy("user_id", ref.alias("ref")).agg(F.count("*").alias("n"), F.min("event_id").alias("first"))


_KNOWN = ", ".join(f"('{f}', {i}, '{m}', '{m.split('.')[0]}', {T.FRAMEWORK_WEIGHTS[f]})" for f, ms in T.FRAMEWORK_MODULES.items() for i, m in enumerate(ms))
_SCORES = f"""{_SEEN_SQL}, k AS (SELECT * FROM (VALUES {_KNOWN}) t(framework, ordinal, module, base, weight)),
o AS (SELECT user_id, framework, base, weight, arg_min(n, ordinal * 10000000 + first) AS n FROM r JOIN k ON split_part(ref, '.', 1) = base AND (ref = module OR starts_with(ref, module || '.')) GROUP BY ALL),
s AS (SELECT user_id, framework, round(least(sum(10 + CASE WHEN n >= 5 THEN 20 WHEN n >= 2 THEN 10 ELSE 5 END) / 100.0 * any_value(weight), 1), 6)::DOUBLE AS confidence FROM o GROUP BY user_id, framework)"""


@_add(f"WITH {_SCORES} SELECT * FROM s")
def framework_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.framework_scores(_seen(spark, sf_dir), "user_id").withColumn("confidence", F.round("confidence", 6))


@_add(f"""WITH {_SCORES}, b AS (SELECT user_id, max(confidence) AS c FROM s GROUP BY user_id), d AS (SELECT user_id, bool_or(ref = 'collections.OrderedDict') AS o FROM r GROUP BY user_id)
SELECT d.user_id, coalesce(c, 0)::DOUBLE AS confidence, coalesce(c, 0) > 0.15 OR (o AND coalesce(c, 0) > 0) AS is_ml FROM d LEFT JOIN b ON d.user_id = b.user_id""")
def ml_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.ml_context(_seen(spark, sf_dir), "user_id").withColumn("confidence", F.round("confidence", 6))


# RE2 has no look-around; for the question whether there is a match this says the same
_MAGIC = r"(?:^|\W)__[a-zA-Z](?:[a-zA-Z0-9_]*[a-zA-Z])?__(?:$|\W)"
_STRINGS = "CASE " + " ".join(f"WHEN regexp_matches(t, {_s(_MAGIC if i == 0 else p)}) THEN {_s(p)}" for i, p in enumerate(T.SUSPICIOUS_STRINGS))
_STRINGS += " WHEN len(t) > 40 AND regexp_matches(t, '^[A-Za-z0-9+/=]+$') AND len(list_distinct(string_split(t, ''))) > 4 AND regexp_matches(t, '[A-Z]') AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') THEN 'potential_base64' END"


@_add(f"WITH {DOCS}, w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS t FROM docs), f AS (SELECT {_STRINGS} AS pattern FROM w) SELECT pattern, count(*) AS n FROM f WHERE pattern IS NOT NULL GROUP BY pattern")
def suspicious_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = payload_docs(spark, sf_dir).select(F.explode(F.split("text", " ")).alias("t"))
    return words.select(V.suspicious_string(F.col("t")).alias("pattern")).where("pattern is not null").groupBy("pattern").agg(F.count("*").alias("n"))
