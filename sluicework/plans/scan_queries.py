"""Queries of whole scans: made-up files of several formats, with the checks that each must fail, by hand."""

from __future__ import annotations

import io
import json
import struct
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import scan as S
from .data import quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _zip(**members: bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), data)
    return out.getvalue()


def _npy(descr: str, data: bytes) -> bytes:
    head = f"{{'descr': '{descr}', 'fortran_order': False, 'shape': (2,), }}".ljust(117) + "\n"
    return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode() + data


def _tensors(end: int) -> bytes:
    head = json.dumps({"w": {"dtype": "F32", "shape": [2], "data_offsets": [0, 8]}, "v": {"dtype": "F32", "shape": [1], "data_offsets": [end, end + 4]}}).encode()
    return struct.pack("<Q", len(head)) + head + bytes(end + 4)


_EVIL = b"cos\nsystem\n(S'id'\ntR."
_LFS = b"version https://git-lfs.github.com/spec/v1\noid sha256:" + b"a" * 64 + b"\nsize 2048\n"
#: Ending and content of the files, by doc_id modulo their number.
FILES = [
    (".pkl", _EVIL),
    (".h5", bytes.fromhex("0011223344")),
    (".bin", _LFS),
    (".zip", _zip(**{"a.pkl": _EVIL, "../b": b"x"})),
    (".npy", _npy("|O", b"\x80\x04N.")),
    (".npy", _npy("<f4", bytes(8))),
    (".safetensors", _tensors(12)),
    (".safetensors", _tensors(8)),
    (".json", json.dumps({"layers": [{"class_name": "Lambda"}], "md5": "0" * 32, "name": "good"}).encode()),
    (".md", b"see ghp_abcdefghijklmnopqrstuvwxyz0123456789 and s3://bucket/x\n"),
    (".py", _EVIL),
    (".lock", _EVIL),
    (".pkl", b"ccollections\nOrderedDict\n(tR."),
]
#: By hand: file, the checks that fail, with severity and rule.
FAILED = [
    (0, "Global Module Reference Check", "critical", "S101"),
    (0, "REDUCE Opcode Safety Check", "critical", "S201"),
    (1, "Format Validation", "warning", "S901"),
    (2, "Git LFS Pointer Detection", "critical", "S902"),
    (3, "Global Module Reference Check", "critical", "S101"),
    (3, "REDUCE Opcode Safety Check", "critical", "S201"),
    (3, "Path Traversal Protection", "critical", "S405"),
    (4, "Object Array Check", "critical", "S213"),
    (6, "Offset Continuity Check", "critical", "S902"),
    (8, "Suspicious Layer Check", "warning", "S1103"),
    (8, "Weak Hash Detection", "warning", "S902"),
    (9, "Secret Detection", "info", "S702"),
    (9, "Network Communication Detection", "info", "S309"),
]
SKIPPED = [10, 11]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id") % len(FILES)
    tail, data = (F.element_at(F.array(*[x(f) for f in FILES]), (n + 1).cast("int")) for x in (lambda f: F.lit(f[0]), lambda f: F.unhex(F.lit(f[1].hex()))))
    path = F.concat(F.lit("/m/"), n.cast("string"), F.lit("/"), F.col("doc_id").cast("string"), tail)
    return table(spark, sf_dir, "documents").select(path.alias("path"), data.alias("content")).withColumn("length", F.octet_length("content").cast("long"))


def _out(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.gettempdir()}"
    return f"{shared}/scan-{uuid.uuid4().hex}"


def _scan(spark: SparkSession, sf_dir: str) -> S.Result:
    return S.scan(_files(spark, sf_dir), _out(spark))


_VALUES = ", ".join(f"({k}, {quoted(n)}, {quoted(s)}, {quoted(r) if r else 'NULL'})" for k, n, s, r in FAILED)
_KEPT = f"doc_id % {len(FILES)} NOT IN ({', '.join(map(str, SKIPPED))})"
# equal contents are scanned once, on the least path as text
_FIRST = f"f AS (SELECT doc_id % {len(FILES)} AS k, min('/m/' || (doc_id % {len(FILES)}) || '/' || doc_id || ([{', '.join(quoted(t) for t, _ in FILES)}])[(doc_id % {len(FILES)} + 1)::INT]) AS path FROM documents WHERE {_KEPT} GROUP BY 1)"


@_add(f"WITH {_FIRST} SELECT path AS asset, name, severity, rule_code FROM f JOIN (VALUES {_VALUES}) t(k, name, severity, rule_code) USING (k)")
def scan_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fails in a scan of files of several formats, after consolidation."""
    out = _scan(spark, sf_dir)
    return out.issues.select(S.checks_.asset_of(F.col("location")).alias("asset"), "name", "severity", "rule_code").distinct()


_SIZES = f"([{', '.join(str(len(c)) for _, c in FILES)}])[(doc_id % {len(FILES)} + 1)::INT]"


@_add(f"""SELECT count(*) AS files_scanned, sum({_SIZES})::BIGINT AS bytes_scanned, count(*) - count(DISTINCT doc_id % {len(FILES)}) AS duplicates, 8::BIGINT AS critical_issues, 3::BIGINT AS warning_issues, false AS has_errors, true AS has_critical, 1 AS exit_code
FROM documents WHERE {_KEPT}""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).summary.select("files_scanned", "bytes_scanned", "duplicates", "critical_issues", "warning_issues", "has_errors", "has_critical", "exit_code")
