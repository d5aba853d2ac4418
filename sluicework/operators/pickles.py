"""Checks of pickle opcodes: references, calls, strings, nested pickles, decode chains and opcode counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import verdicts as V
from .sequences import stream_ids

CHECK = "path string, seq bigint, name string, status string, severity string, message string, location string, rule_code string"
#: Opcodes that can run code; those that only keep or fetch values don't count; frameworks and classes of tree ensembles; decoders and what they may feed.
COUNTED = ["REDUCE", "INST", "OBJ", "NEWOBJ", "NEWOBJ_EX", "BUILD", "GLOBAL", "STACK_GLOBAL", "EXT1", "EXT2", "EXT4"]
TREE_FRAMEWORKS = ["sklearn", "xgboost", "lightgbm"]
TREE_CLASSES = ["RandomForest", "ExtraTrees", "GradientBoosting", "HistGradientBoosting", "DecisionTree", "XGB", "LGBM", "CatBoost", "IsolationForest", "AdaBoost"]
DECODERS = ["base64", "codecs", "binascii"]
BASE_THRESHOLD = 50


def _check(name: Column | str, status: Column | str, severity: Column | str | None, message: Column, rule: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(
        as_column(name).alias("name"),
        as_column(status).alias("status"),
        as_column(severity).alias("severity"),
        message.alias("message"),
        as_column(rule).alias("rule_code"),
    )


def call_verdicts(ops: DataFrame, safe: Sequence[str] = V.SAFE_GLOBALS) -> DataFrame:
    """``ops`` with checks: what each opcode alone gives rise to. One pass; verdicts are columns of a first projection, so each is worked out once."""
    m, f, cm, cf, name = (F.col(c) for c in ("module", "function", "called_module", "called_function", "name"))
    strings = ["STRING", "BINSTRING", "SHORT_BINSTRING", "UNICODE", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8"]
    verdicts = {
        "bad_": F.when(m.isNotNull(), V.dangerous_global(m, f, safe)),
        "called_bad_": F.when(cm.isNotNull(), V.dangerous_global(cm, cf, safe)),
        "called_safe_": V.is_safe(cm, cf, safe),
        "pattern_": F.when(name.isin(*strings), V.suspicious_string(F.col("arg"))),
        "import_rule_": F.when(m.isNotNull(), V.import_rule(m, f)),
    }
    rows = ops.withColumns(verdicts)
    rows = rows.withColumn("string_rule_", F.when(F.col("pattern_").isNotNull(), V.mapped_rule(F.col("arg"))))
    ref, called = F.concat(m, F.lit("."), f), F.concat(cm, F.lit("."), cf)
    severity = F.when(m.isin(*T.WARNING_MODULES), "warning").otherwise("critical")
    reference = F.when(
        name.isin("GLOBAL", "STACK_GLOBAL", "INST", "EXT1", "EXT2", "EXT4") & m.isNotNull(),
        F.when(F.col("bad_"), _check("Global Module Reference Check", "failed", severity, F.concat(F.lit("Suspicious reference "), ref), F.coalesce("import_rule_", V.opcode_rule(name)))).otherwise(
            _check("Global Module Reference Check", "passed", None, F.concat(F.lit("Safe global reference validated: "), ref))
        ),
    )
    label, kind = F.concat(name, F.lit(" opcode")), F.concat(name, F.lit(" Opcode Safety Check"))
    call = F.when(
        name.isin("REDUCE", "INST", "OBJ", "NEWOBJ", "NEWOBJ_EX") & cm.isNotNull(),
        F.when(F.col("called_safe_"), _check(kind, "passed", "info", F.concat(label, F.lit(" with safe ML framework global: "), called)))
        .when(F.col("called_bad_"), _check(kind, "failed", "critical", F.concat(label, F.lit(" with non-allowlisted global: "), called), V.opcode_rule(name)))
        .when(~V.plausible_module(cm), _check(kind, "passed", "info", F.concat(label, F.lit(" with implausible module name '"), cm, F.lit("' (likely data, not a real import): "), called)))
        .otherwise(_check(kind, "failed", "warning", F.concat(label, F.lit(" with non-allowlisted global: "), called), V.opcode_rule(name))),
    )
    rule = F.when(F.contains("arg", F.lit("subprocess")), "S103").when(F.contains("arg", F.lit("__import__")), "S106").when(F.contains("arg", F.lit("compile")), "S105").otherwise(F.col("string_rule_"))
    string = F.when(F.col("pattern_").isNotNull(), _check("String Pattern Security Check", "failed", "warning", F.concat(F.lit("Suspicious string pattern: "), "pattern_"), rule))
    nested = F.when(F.col("nested"), _check("Nested Pickle Detection", "failed", "critical", F.lit("Nested pickle payload detected"), F.lit("S213")))
    broken = F.when(F.col("error").isNotNull(), _check("Pickle Parse Check", "failed", "warning", F.col("error"), F.lit("S902")))
    return rows.withColumn("checks", F.array_compact(F.array(reference, call, string, nested, broken))).drop(*verdicts, "string_rule_")


def counted(ops: DataFrame, safe: Sequence[str] = V.SAFE_GLOBALS) -> Column:
    """Whether an opcode counts as dangerous. A BUILD counts unless the last construction before it was safe."""
    name = F.col("name")
    target = V.is_safe(F.col("called_module"), F.col("called_function"), safe)
    ref = V.is_safe(F.col("module"), F.col("function"), safe)
    built = F.when(name.isin("REDUCE", "NEWOBJ", "NEWOBJ_EX", "INST", "OBJ", "EXT1", "EXT2", "EXT4"), F.coalesce(target, F.lit(False)) & ~name.isin("INST", "OBJ", "EXT1", "EXT2", "EXT4"))
    last = F.last(built, ignorenulls=True).over(Window.partitionBy("path", "stream").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return (
        F.when(name.isin("REDUCE", "NEWOBJ", "NEWOBJ_EX"), ~F.coalesce(target, F.lit(False)))
        .when(name == "BUILD", ~F.coalesce(last, F.lit(False)))
        .when(name.isin("GLOBAL", "STACK_GLOBAL"), F.col("module").isNull() | (~ref & V.plausible_module(F.col("module"))))
        .otherwise(name.isin("INST", "OBJ", "EXT1", "EXT2", "EXT4"))
    )


def thresholds(ops: DataFrame) -> DataFrame:
    """path, stream, threshold: 50, or more where a stream builds an ensemble of trees."""
    refs = ops.where("module is not null").groupBy("path", F.concat_ws(".", "module", "function").alias("ref")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    modules = ops.where("module is not null").groupBy("path", F.col("module").alias("ref")).agg(F.count("*").alias("n"), F.min("idx").alias("first"))
    both = refs.unionByName(modules)
    context = V.ml_context(both, "path").withColumnRenamed("path", "of_path")
    known = V.framework_scores(both, "path").groupBy(F.col("path").alias("f_path")).agg(F.collect_set("framework").alias("frameworks"))
    ref = F.concat_ws(".", F.coalesce("module", "called_module"), F.coalesce("function", "called_function"))
    trees = F.lit(False)
    for c in TREE_CLASSES:
        trees = trees | F.contains(ref, F.lit(c))
    under = [F.bool_or(F.startswith(F.lower(ref), F.lit(f))).alias(f) for f in TREE_FRAMEWORKS]
    streams = ops.groupBy("path", "stream").agg(F.count("*").alias("length"), F.bool_or(trees).alias("trees"), *under)
    out = streams.join(context, F.col("path") == F.col("of_path"), "left").join(known, F.col("path") == F.col("f_path"), "left")
    framework = F.lit(False)
    for f in TREE_FRAMEWORKS:
        framework = framework | (F.col(f) & F.array_contains("frameworks", f))
    raised = F.coalesce(F.col("is_ml") & F.col("trees") & framework, F.lit(False))
    wide = F.when(F.col("confidence") >= 0.15, F.greatest(F.lit(5000), F.floor(F.col("length") / 2))).otherwise(F.greatest(F.lit(500), F.floor(F.col("length") / 10)))
    return out.select("path", "stream", F.when(raised, wide).otherwise(BASE_THRESHOLD).cast("long").alias("threshold"))


def opcode_counts(ops: DataFrame, safe: Sequence[str] = V.SAFE_GLOBALS) -> DataFrame:
    """path, idx, pos, name: where a stream's count of dangerous opcodes passes its threshold and starts again."""
    rows = stream_ids(ops, "path", "idx", "name", "STOP")
    marked = rows.withColumn("counts", counted(rows, safe) & (F.col("name") != "STOP"))
    limit = thresholds(rows).withColumnsRenamed({"path": "t_path", "stream": "t_stream"})
    total = F.sum(F.col("counts").cast("long")).over(Window.partitionBy("path", "stream").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("total", total).join(limit, (F.col("path") == F.col("t_path")) & (F.col("stream") == F.col("t_stream")))
    return out.where("counts and total % (threshold + 1) = 0").select("path", "idx", "pos", "name")


def decode_chains(ops: DataFrame) -> DataFrame:
    """path, idx, pos: a reference to a decoder with one to a loader or evaluator among the next five opcodes."""
    m, f = F.col("module"), F.col("function")
    runs = (F.col("name") == "GLOBAL") & (((m == "pickle") & f.isin("loads", "load")) | ((m == "builtins") & f.isin("eval", "exec")))
    ahead = F.max(runs.cast("int")).over(Window.partitionBy("path").orderBy("idx").rowsBetween(1, 5))
    first = (F.col("name") == "GLOBAL") & m.isin(*DECODERS) & F.contains(f, F.lit("decode"))
    return ops.withColumn("ahead_", ahead).where(first & (F.col("ahead_") == 1)).select("path", "idx", "pos")


def pickle_checks(ops: DataFrame, safe: Sequence[str] = V.SAFE_GLOBALS) -> DataFrame:
    """path, seq, name, status, severity, message, location, rule_code of all checks of pickle opcodes."""
    each = call_verdicts(ops, safe).select("path", "idx", "pos", F.posexplode("checks").alias("k", "c"))
    location = F.concat("path", F.lit(" (pos "), F.coalesce(F.col("pos"), F.lit(0)).cast("string"), F.lit(")"))
    rows = each.select("path", (F.col("idx") * 8 + F.col("k")).alias("seq"), "c.name", "c.status", "c.severity", "c.message", location.alias("location"), "c.rule_code")
    many = opcode_counts(ops, safe).select("path", (F.col("idx") * 8 + 5).alias("seq"), F.lit("Opcode Sequence Check").alias("name"), F.lit("failed").alias("status"), F.lit("warning").alias("severity"), F.lit("Many dangerous opcodes").alias("message"), location.alias("location"), F.lit("S201").alias("rule_code"))
    chains = decode_chains(ops).select("path", (F.col("idx") * 8 + 6).alias("seq"), F.lit("Opcode Sequence Check").alias("name"), F.lit("failed").alias("status"), F.lit("critical").alias("severity"), F.lit("Decoded data is executed").alias("message"), location.alias("location"), F.lit("S104").alias("rule_code"))
    return rows.unionByName(many).unionByName(chains)
