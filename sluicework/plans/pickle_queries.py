"""Queries of pickle opcodes: streams built from short programs, with what each must give, by hand."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pickles as P
from ..sources import binary as B
from .data import quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _short(text: str) -> bytes:
    return b"\x8c" + bytes([len(text)]) + text.encode()


_NESTED = b"(lp0\nI1\na."
#: Pickles by doc_id modulo their number.
PROGRAMS = [
    b"cos\nsystem\n(S'id'\ntR.",  # 0 a call of a dangerous function
    b"ccollections\nOrderedDict\n(tR.",  # 1 an allowed one
    b"\x80\x04" + _short("os") + _short("system") + b"\x93" + _short("id") + b"\x85R.",  # 2 names on the stack
    b"\x80\x04" + _short("subprocess") + b"\x94" + _short("Popen") + b"\x940" + b"h\x00h\x01\x93)R.",  # 3 names through the memo
    b"csklearn.tree\nThing\n(tR.",  # 4 neither allowed nor dangerous
    b"cPEDRA_2020\nx\n(tR.",  # 5 no module
    b"S'import os'\n.",  # 6 a suspicious string
    b"\x80\x03C" + bytes([len(_NESTED)]) + _NESTED + b".",  # 7 a pickle in bytes
    b"cbase64\nb64decode\ncpickle\nloads\n.",  # 8 decoded data is loaded
    b"(ios\nsystem\n.",  # 9 INST
    b"ctorch._utils\n_rebuild_tensor_v2\n(tRcos\nsystem\n0.",  # 10 two references
    b"cfunctools\npartial\n(tR.",  # 11 a module that is only warned of
    b"\x80\x04" + _short(base64.b64encode(b"cos\nsystem\n(S'id'\ntR.").decode()) + b".",  # 12 a pickle in base64
    b"\x82\x05)R.",  # 13 an extension
    b"cos\nsys",  # 14 cut off
]

_C = ["name", "status", "severity", "rule"]
_REF, _RED, _INST = "Global Module Reference Check", "REDUCE Opcode Safety Check", "INST Opcode Safety Check"
#: By hand: program, check, status, severity, rule.
EXPECTED = [
    (0, _REF, "failed", "critical", "S101"),
    (0, _RED, "failed", "critical", "S201"),
    (1, _REF, "passed", None, None),
    (1, _RED, "passed", "info", None),
    (2, _REF, "failed", "critical", "S101"),
    (2, _RED, "failed", "critical", "S201"),
    (3, _REF, "failed", "critical", "S103"),
    (3, _RED, "failed", "critical", "S201"),
    (4, _REF, "passed", None, None),
    (4, _RED, "failed", "warning", "S201"),
    (5, _REF, "passed", None, None),
    (5, _RED, "passed", "info", None),
    (6, "String Pattern Security Check", "failed", "warning", None),
    (7, "Nested Pickle Detection", "failed", "critical", "S213"),
    (8, _REF, "failed", "critical", "S206"),
    (8, _REF, "failed", "critical", "S213"),
    (8, "Opcode Sequence Check", "failed", "critical", "S104"),
    (9, _REF, "failed", "critical", "S101"),
    (9, _INST, "failed", "critical", "S202"),
    (10, _REF, "passed", None, None),
    (10, _RED, "passed", "info", None),
    (10, _REF, "failed", "critical", "S101"),
    (11, _REF, "failed", "warning", "S206"),
    (11, _RED, "failed", "critical", "S201"),
    (12, "Nested Pickle Detection", "failed", "critical", "S213"),
    (13, _REF, "failed", "critical", "S211"),
    (13, _RED, "failed", "critical", "S201"),
    (14, "Pickle Parse Check", "failed", "warning", "S902"),
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = F.element_at(F.array(*[F.unhex(F.lit(p.hex())) for p in PROGRAMS]), (F.col("doc_id") % len(PROGRAMS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("/p/"), F.col("doc_id").cast("string"), F.lit(".pkl")).alias("path"), program.alias("content"))


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else quoted(x)


_ROWS = ", ".join("(" + ", ".join(map(_value, r)) + ")" for r in EXPECTED)


@_add(f"SELECT '/p/' || doc_id || '.pkl' AS path, name, status, severity, rule_code FROM documents JOIN (VALUES {_ROWS}) t(k, name, status, severity, rule_code) ON k = doc_id % {len(PROGRAMS)}")
def pickle_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pickle_checks(B.opcodes(_files(spark, sf_dir))).select("path", "name", "status", "severity", "rule_code")


#: By hand: program, opcode, what it calls.
CALLED = [(0, "REDUCE", "os", "system"), (1, "REDUCE", "collections", "OrderedDict"), (2, "REDUCE", "os", "system"), (3, "REDUCE", "subprocess", "Popen"), (4, "REDUCE", "sklearn.tree", "Thing"), (5, "REDUCE", "PEDRA_2020", "x"), (9, "INST", "os", "system"), (10, "REDUCE", "torch._utils", "_rebuild_tensor_v2"), (11, "REDUCE", "functools", "partial"), (13, "REDUCE", B.EXTENSION, "ext_5")]


@_add(f"SELECT '/p/' || doc_id || '.pkl' AS path, name, called_module, called_function FROM documents JOIN (VALUES {', '.join(str(x) for x in CALLED)}) t(k, name, called_module, called_function) ON k = doc_id % {len(PROGRAMS)}")
def called_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.opcodes(_files(spark, sf_dir)).where("called_module is not null").select("path", "name", "called_module", "called_function")


# streams of NEWOBJ without a known class: more than the threshold of 50 gives an alert, a second one needs 51 more
@_add("""WITH d AS (SELECT doc_id, doc_id % 120 AS n FROM documents) SELECT '/p/' || doc_id || '.pkl' AS path, (n // 51)::BIGINT AS alerts FROM d WHERE n >= 51""")
def opcode_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.expr("X'4E294E81'")  # None, empty tuple, None, NEWOBJ
    n = F.col("doc_id") % 120
    body = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("cast(array() as array<bigint>)")), F.expr("X'8003'"), lambda a, _: F.concat(a, one))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/p/"), F.col("doc_id").cast("string"), F.lit(".pkl")).alias("path"), F.concat(body, F.expr("X'4E2E'")).alias("content"))
    return P.opcode_counts(B.opcodes(files)).groupBy("path").agg(F.count("*").alias("alerts"))
