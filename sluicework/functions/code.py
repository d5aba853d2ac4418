"""What Python source does, by its syntax tree. Code is parsed and never run.

Spark has no syntax trees, so rows are mapped in Arrow batches; texts that can't
be code are left to the callers' filters.
"""

from __future__ import annotations

import ast
import re
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T

#: Weights of constructs, limits of the score, imports and calls that count, harmless arguments of eval, signs of obfuscation.
WEIGHTS = {"run": 10, "process": 8, "file": 5, "network": 5, "variadic": 4, "import": 2}
LIMITS = {"low": 5, "medium": 10, "high": 20}
IMPORTS = {"os", "sys", "subprocess", "socket", "urllib", "requests"}
CALLS = {"eval": "run", "exec": "run", "compile": "run", "__import__": "run", "open": "file", "file": "file", "system": "process", "popen": "process"}
METHODS = {"os.system": "process", "os.popen": "process", "subprocess.run": "process", "subprocess.call": "process", "subprocess.Popen": "process", "socket.socket": "network", "socket.connect": "network"}
HARMLESS = [r"eval\s*\(\s*['\"][\d\s\+\-\*/\(\)\.]+['\"]\s*\)", r"eval\s*\(\s*['\"]df\[.+\]['\"]\s*\)", r"pickle\.load\s*\(\s*open\s*\(\s*['\"][\w/\-_\.]+\.pkl['\"]"]
LEVELS = [(0, "safe"), (1, "low"), (3, "medium"), (5, "high")]
CLEAR_PATTERNS = [r"eval\s*\(", r"exec\s*\(", r"__import__\s*\("]
OBFUSCATION = [
    ("base64_encoded_strings", r"base64\.b64decode\s*\(['\"][A-Za-z0-9+/=]{20,}['\"]\)"),
    ("hex_encoded_strings", r"bytes\.fromhex\s*\(['\"][0-9a-fA-F]{20,}['\"]\)"),
    ("chr_concatenation", r"chr\s*\(\d+\)\s*\+\s*chr\s*\(\d+\)"),
    ("excessive_getattr", r"(?s)(?:getattr.*?){6}"),
    ("dynamic_import", r"__import__"),
    ("complex_exec", r"exec\s*\([^'\"][^)]{20,}\)"),
]


def parsed(code: str | None) -> ast.AST | None:
    """The syntax tree, or None for what is no code."""
    if not code:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except Exception:  # syntax, depth, null signs
        return None


def valid(code: str | None) -> bool:
    """Whether the text compiles; what stands outside of its place ("return" alone) doesn't."""
    if parsed(code) is None:
        return False
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(code, "text", "exec", dont_inherit=True)
    except Exception:
        return False
    return True


def dotted(node: ast.expr) -> str | None:
    """a.b.c of a called expression; what hangs on no name gives its attributes alone."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if isinstance(node, ast.Name):
        parts.append(node.id)
    return ".".join(reversed(parts)) or None


def constructs(code: str) -> list[str]:
    """Kind of each dangerous construct, in the words of WEIGHTS."""
    found = []
    for node in ast.walk(parsed(code) or ast.Module([], [])):
        match node:
            case ast.Import(names=names):
                found += ["import" for n in names if n.name in IMPORTS]
            case ast.ImportFrom(module=module) if module in IMPORTS:
                found.append("import")
            case ast.Call(func=ast.Name(id=name)) if name in CALLS:
                found.append(CALLS[name])
            case ast.Call(func=ast.Attribute(value=ast.Name(id=of), attr=name)) if f"{of}.{name}" in METHODS:
                found.append(METHODS[f"{of}.{name}"])
            case ast.Lambda(args=args):
                found += ["variadic"] * ((args.vararg is not None) + (args.kwarg is not None))
    return found


def risk(code: str) -> int:
    return sum(WEIGHTS[k] for k in constructs(code))


def dangerous_string(text: str) -> str | None:
    """The first pattern whose surroundings are code that matters, or that is clear without; then long base64."""
    for pattern in T.CODE_STRINGS:
        m = re.search(pattern, text, re.IGNORECASE)
        if not m:
            continue
        near = text[max(0, m.start() - 50) : m.end() + 50].strip()
        if valid(near):
            if risk(near) >= LIMITS["low"]:
                return pattern
        elif pattern in CLEAR_PATTERNS:
            return pattern
    if len(text) > 100 and re.fullmatch(r"[A-Za-z0-9+/=]+\n?", text) and len(set(text)) > 4:
        return "potential_base64"
    return None


def _harmless_call(name: str, code: str, framework: str | None) -> bool:
    if any(re.search(p, code) for p in HARMLESS):
        return True
    if framework and name in T.SAFE_CALLS["ml_operations"]:
        return True
    return name in ("eval", "exec") and any(re.match(r"['\"][\d\s\+\-\*/\(\)\.]+['\"]", x.strip()) for x in re.findall(rf"{name}\s*\(([^)]+)\)", code))


def behaviour(code: str, framework: str | None = None) -> tuple[str, float | None]:
    """Level and score: risks less half of what mitigates them. What is no code is medium without a score."""
    tree = parsed(code)
    if tree is None:
        return "medium", None
    calls, imports = set(), set()
    for node in ast.walk(tree):
        match node:
            case ast.Call(func=func):
                calls.add(dotted(func))
            case ast.Import(names=names):
                imports.update(n.name for n in names)
            case ast.ImportFrom(module=str(module)):
                imports.add(module)
    calls.discard(None)
    risks = mild = 0
    for name in calls & set(T.RISKY_CALLS):
        if _harmless_call(name, code, framework):
            mild += 1
        else:
            risks += 1
    risks += sum(all(calls & side for side in pair) for pair in (({"eval", "exec"}, {"requests", "urllib"}), ({"subprocess", "os.system"}, {"input", "request"}), ({"open", "write"}, {"os.environ", "sys.path"})))
    for name in imports & set(T.RISKY_IMPORTS):
        used = [c for c in calls if c.startswith(name)]
        if not used or (name in T.SAFE_USES and set(used) <= set(T.SAFE_USES[name])):
            mild += 1
        else:
            risks += 1
    if framework == "pytorch" and "torch.load" in calls:
        for m in re.finditer(r"torch\.load\s*\(([^,\)]+)", code):
            if "map_location" in code[m.start(1) : m.start(1) + 100] or re.match(r"['\"][\w/\-_\.]+['\"]", m[1].strip()):
                mild += 1
                break
    score = risks - 0.5 * mild
    return next((name for limit, name in LEVELS if score <= limit), "critical"), score


def obfuscation(text: Column) -> Column:
    """Names of the signs of obfuscation in a text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in OBFUSCATION]))


def analysed(rows: DataFrame, text: str, *keep: str, framework: str | None = None) -> DataFrame:
    """keep, is_code, risk, level, score, dangerous: each text as source code."""
    names = [f"k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            codes = [x or "" for x in batch.column(0).to_pylist()]
            levels = [behaviour(x, framework) for x in codes]
            columns = [
                pa.array([valid(x) for x in codes], pa.bool_()),
                pa.array([risk(x) for x in codes], pa.int64()),
                pa.array([x for x, _ in levels], pa.string()),
                pa.array([x for _, x in levels], pa.float64()),
                pa.array([dangerous_string(x) for x in codes], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], names=[*names, "is_code", "risk", "level", "score", "dangerous"])

    own = rows.select(F.col(text).alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = "".join(f"{n} {own.schema[n].dataType.simpleString()}, " for n in names)
    return own.mapInArrow(run, f"{schema}is_code boolean, risk long, level string, score double, dangerous string").toDF(*keep, "is_code", "risk", "level", "score", "dangerous")
