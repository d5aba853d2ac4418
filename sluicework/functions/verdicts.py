"""Verdicts on references to code: which globals are dangerous, which module names can be real, and the rule of a finding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T

#: The module of what an extension opcode refers to.
EXTENSION = "copyreg._extension_registry"
#: Globals that stay allowed though their module may be dangerous; a parameter, of which this is the common core ("module name").
SAFE_GLOBALS = [
    *(f"builtins {x}" for x in "set frozenset slice list dict tuple int float str bytes bytearray bool complex range object".split()),
    *(f"__builtin__ {x}" for x in "set frozenset slice list dict tuple int float str bytes bool complex object long unicode".split()),
    *(f"collections {x}" for x in "OrderedDict defaultdict deque Counter".split()),
    *(f"copyreg {x}" for x in "_reconstructor __newobj__".split()),
    *(f"copy_reg {x}" for x in "_reconstructor __newobj__".split()),
    *(f"_codecs {x}" for x in "encode".split()),
    *(f"torch._utils {x}" for x in "_rebuild_tensor _rebuild_tensor_v2 _rebuild_parameter _rebuild_sparse_tensor".split()),
    *(f"torch {x}" for x in "FloatStorage DoubleStorage HalfStorage BFloat16Storage LongStorage IntStorage ShortStorage CharStorage ByteStorage BoolStorage Size device dtype Tensor".split()),
    *(f"torch.nn.parameter {x}" for x in "Parameter Buffer".split()),
    *(f"numpy {x}" for x in "ndarray dtype float32 float64 int32 int64 bool_".split()),
    *(f"{m}.multiarray {x}" for m in ("numpy.core", "numpy._core") for x in "_reconstruct scalar".split()),
    *(f"datetime {x}" for x in "date datetime time timedelta timezone".split()),
]

#: Names of the builtins module and of its functions that run code.
BUILTINS = ["__builtin__", "__builtins__", "builtins"]
NEAR_BUILTINS = ["__builtin", "builtin", "__builtins", "builtins"]
RUNNING = ["eval", "exec", "execfile", "compile", "__import__"]


def is_safe(module: Column, name: Column, safe: Sequence[str] = SAFE_GLOBALS) -> Column:
    return F.concat(module, F.lit(" "), name).isin(*safe)


def dangerous_module(module: Column) -> Column:
    """Whether the module, or one that it is under, is always dangerous."""
    parts = F.split(module, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    return F.exists(above, lambda m: m.isin(*T.DANGEROUS_MODULES))


def suspicious_global(module: Column, name: Column) -> Column:
    whole = [m for m, names in T.SUSPICIOUS_GLOBALS.items() if names == "*"]
    named = [f"{m} {n}" for m, names in T.SUSPICIOUS_GLOBALS.items() if names != "*" for n in names]
    builtin = module.isin(*BUILTINS) | F.lower(F.trim(module)).isin(*NEAR_BUILTINS)
    return module.isin(*whole) | F.concat(module, F.lit(" "), name).isin(*named) | (builtin & name.isin(*RUNNING))


def dangerous_global(module: Column, name: Column, safe: Sequence[str] = SAFE_GLOBALS) -> Column:
    """Extension references and always dangerous functions, whatever is allowed; then dangerous modules but for allowed globals; then suspicious ones."""
    always = F.concat(module, F.lit("."), name).isin(*T.DANGEROUS_FUNCTIONS) | name.isin(*T.DANGEROUS_FUNCTIONS)
    allowed = is_safe(module, name, safe)
    return F.when((module == EXTENSION) | always, True).when(dangerous_module(module), ~allowed).when(allowed, False).otherwise(suspicious_global(module, name))


def plausible_module(module: Column) -> Column:
    """Whether the name can be a module's: lower-case segments. Others are data that look like references."""
    return F.coalesce(module.rlike(r"^[a-z_][a-z0-9_]*(\.[a-z_][a-z0-9_]*)*$"), F.lit(False))


#: Rule of a module; names are compared in lower case, some also between two underscores.
_MODULES = [
    ("S101", ["os", "__os__"]),
    ("S102", ["sys", "__sys__"]),
    ("S103", ["subprocess", "__subprocess__"]),
    ("S301", ["socket", "__socket__"]),
    ("S107", ["importlib", "__importlib__"]),
    ("S108", ["runpy", "__runpy__"]),
    ("S109", ["webbrowser", "__webbrowser__"]),
    ("S110", ["ctypes", "__ctypes__"]),
    ("S111", ["pty", "tty", "__pty__", "__tty__"]),
    ("S112", ["code", "__code__"]),
    ("S113", ["types"]),
    ("S114", ["ast", "__ast__"]),
    ("S302", ["requests", "urllib", "urllib2", "urllib3"]),
    ("S303", ["http.client", "httplib", "httplib2"]),
    ("S304", ["ftplib"]),
    ("S305", ["telnetlib"]),
    ("S306", ["smtplib"]),
    ("S403", ["shutil"]),
    ("S404", ["tempfile"]),
    ("S213", ["pickle", "cpickle", "_pickle", "dill", "cloudpickle"]),
]
#: Rule of an opcode.
OPCODE_RULES = {"REDUCE": "S201", "INST": "S202", "OBJ": "S203", "NEWOBJ": "S204", "STACK_GLOBAL": "S205", "GLOBAL": "S206", "GLOBALS": "S206", "BUILD": "S207", "SETATTR": "S208", "SETITEM": "S209", "SETITEMS": "S210", "EXT1": "S211", "EXT2": "S211", "EXT4": "S211"}
#: Rules of a finding by its words, by category in the order in which a message tries them: code, groups of words, of each of which one must be there.
MAPPERS = {
    "file": [("S405", [["traversal", "../"]]), ("S406", [["symlink"]]), ("S408", [["system"], ["file"]]), ("S410", [["archive"], ["bomb"]]), ("S901", [["mismatch"], ["type", "extension"]]), ("S902", [["corrupt"]]), ("S903", [["magic"], ["bytes"]]), ("S904", [["size"], ["large", "excessive"]]), ("S905", [["suspicious"], ["pattern", "config"]]), ("S908", [["polyglot"]])],
    "network": [("S301", [["socket"]]), ("S302", [["requests", "urllib", "urlopen", "urlretrieve"]]), ("S303", [["http.client", "httplib", "httpconnection"]]), ("S304", [["ftp"]]), ("S305", [["telnet"]]), ("S306", [["smtp"]]), ("S307", [["dns", "gethostby", "resolve"]]), ("S308", [["ipv4", "ipv6", "ip address"]]), ("S310", [["network_function", "explicit_network_pattern", "blacklisted_domain", "suspicious_port", "c&c", "exfil", "backdoor", "beacon"]]), ("S309", [["url", "domain", "cloud_storage_url", "http://", "https://"]])],
    "encoding": [("S601", [["base64", "b64"]]), ("S602", [["hex"]]), ("S603", [["zlib", "compress"]]), ("S604", [["encrypt", "obfuscat"]]), ("S605", [["unicode"]]), ("S606", [["rot13", "caesar"]]), ("S607", [["xor"]]), ("S609", [["url", "percent"]]), ("S610", [["custom", "unknown"]])],
    "secret": [("S701", [["api"], ["key"]]), ("S702", [["password", "passwd"]]), ("S703", [["private"], ["key"]]), ("S704", [["aws", "akia"]]), ("S705", [["azure", "gcp"]]), ("S706", [["mongodb", "postgresql", "mysql", "sqlite"]]), ("S707", [["jwt", "bearer"]]), ("S708", [["oauth", "access_token"]]), ("S709", [["webhook"]]), ("S710", [["entropy"]])],
    "code": [("S510", [["torchscript", "jit"]]), ("S501", [["windows", "pe executable", "portable executable", "mz header", ".exe", " exe"]]), ("S502", [["elf", "linux"]]), ("S503", [["mach-o", "macos"]]), ("S504", [["shell", "bash", "#!/bin/sh", ".sh"]]), ("S505", [["batch", ".bat", ".cmd"]]), ("S506", [["powershell", "ps1"]]), ("S507", [["python"], ["script"]]), ("S508", [["javascript", ".js"]]), ("S509", [["wasm", "webassembly"]])],
    "model": [("S801", [["weight"], ["distribution"]]), ("S802", [["outlier"], ["neuron"]]), ("S803", [["dissimilar"], ["vector"]]), ("S804", [["dimension"], ["excessive"]]), ("S807", [["backdoor", "trojan"]]), ("S1001", [["blacklist"]]), ("S1002", [["malicious"], ["hash"]]), ("S1003", [["typosquat"]]), ("S1101", [["torch.load"]]), ("S1101", [["unsafe"], ["pytorch"]]), ("S1103", [["lambda"], ["layer"]])],
    "rest": [("S212", [["protocol"], ["version"]]), (None, [["stack"], ["depth"]]), (None, [["timeout", "timed out"]]), (None, [["opcode"], ["count"]]), ("S999", [["unknown"], ["opcode", "operation"]])],
}


def import_rule(module: Column, name: Column) -> Column:
    """The rule of a reference to a module's function; null where there is none."""
    low, out = F.lower(module), F
    for code, names in _MODULES[:12]:
        out = out.when(low.isin(*names), F.lit(code))
    called = F.lower(F.coalesce(name, F.lit("")))
    own = F.when(called.isin("eval", "exec", "execfile"), "S104").when(called == "compile", "S105").when(called == "__import__", "S106").otherwise("S115")
    out = out.when(low.isin(*BUILTINS), own)
    for code, names in _MODULES[12:]:
        out = out.when(low.isin(*names), F.lit(code))
    return out


def opcode_rule(opcode: Column) -> Column:
    out = F
    for k, v in OPCODE_RULES.items():
        out = out.when(F.upper(opcode) == k, F.lit(v))
    return out


def mapped_rule(text: Column, *categories: str) -> Column:
    """The rule of a finding by its words: the first of the categories (default: all) that knows it."""
    low, out = F.lower(text), F
    for category in categories or MAPPERS:
        for code, groups in MAPPERS[category]:
            hit = F.lit(True)
            for words in groups:
                one = F.lit(False)
                for w in words:
                    one = one | F.contains(low, F.lit(w))
                hit = hit & one
            out = out.when(hit, F.lit(code))
    return out


def framework_scores(refs: DataFrame, key: str) -> DataFrame:
    """key, framework, confidence: which frameworks a stream's references tell. refs: key, ref, n, first.

    Of each top module the first reference under a framework's module counts,
    10 and 20, 10 or 5 more if it occurs five times, twice or once.
    """
    rows = [(f, i, m, m.split(".")[0]) for f, modules in T.FRAMEWORK_MODULES.items() for i, m in enumerate(modules)]
    known = refs.sparkSession.createDataFrame(rows, "framework string, ordinal int, module string, base string")
    weights = refs.sparkSession.createDataFrame(list(T.FRAMEWORK_WEIGHTS.items()), "of_framework string, weight double")
    base = F.substring_index("ref", ".", 1)
    under = (base == F.col("base")) & ((F.col("ref") == F.col("module")) | F.startswith("ref", F.concat("module", F.lit("."))))
    hit = refs.join(F.broadcast(known), under)  # 34 rows
    one = hit.groupBy(key, "framework", "base").agg(F.min_by("n", F.struct("ordinal", "first")).alias("n"))
    score = F.sum(10 + F.when(F.col("n") >= 5, 20).when(F.col("n") >= 2, 10).otherwise(5))
    out = one.groupBy(key, "framework").agg(score.alias("score")).join(F.broadcast(weights), F.col("framework") == F.col("of_framework"))
    return out.select(key, "framework", F.least(F.col("score") / 100.0 * F.col("weight"), F.lit(1.0)).alias("confidence"))


def ml_context(refs: DataFrame, key: str) -> DataFrame:
    """key, confidence, is_ml: the greatest confidence; an ordered dictionary alone tells a model."""
    best = framework_scores(refs, key).groupBy(F.col(key).alias("of")).agg(F.max("confidence").alias("confidence"))
    dicts = refs.groupBy(key).agg(F.bool_or(F.col("ref") == "collections.OrderedDict").alias("ordered"))
    out = dicts.join(best, F.col(key) == F.col("of"), "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
    return out.select(key, "confidence", ((F.col("confidence") > 0.15) | (F.col("ordered") & (F.col("confidence") > 0))).alias("is_ml"))


def suspicious_string(text: Column) -> Column:
    """The first pattern that finds something suspicious in a string; then what looks like base64; else null."""
    out = F
    for p in T.SUSPICIOUS_STRINGS:
        out = out.when(text.rlike(p), F.lit(p))
    signs = F.array_distinct(F.split(text, ""))
    base64 = (F.length(text) > 40) & text.rlike("^[A-Za-z0-9+/=]+$") & (F.size(signs) > 4) & text.rlike("[A-Z]") & text.rlike("[a-z]") & text.rlike("[0-9]")
    return out.when(base64, "potential_base64")
