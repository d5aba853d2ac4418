"""Queries of files, sequences, groups, sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import tables as T
from ..operators import groups as G
from ..operators import sequences as S
from ..operators.checks import asset_of
from ..sources import reports
from .data import CHECKS, checks, quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _values(values: list[str]) -> str:
    return ", ".join(map(quoted, values))


def _x(text: str) -> str:
    return text.encode("latin-1").hex().upper()


#: Endings of the made-up paths, by doc_id modulo their number.
_TAILS = [".pkl", ".tar.gz", ".h5", "/README", "/.hidden", "/.hidden.pt", ".md", ".PT", ".py", ".gguf", "/setup.py", ".bin", "/../x", ".npy", ".npz", ".zip", ".keras", ".onnx", ".safetensors", "-symbol.json", ".xz", ".model", ".cbm", ".lock", "/HEAD", ".mar", ".tgz", ".json", ".joblib", "/LICENSE", ".csv", ".pmml", ".t7"]
#: First bytes of the made-up files in hex, and by hand what they are by the first 16 bytes and by content.
_HEADS = [
    ("80048C0161", "pickle", "pickle"),
    ("1F8B0800", "gzip", "gzip"),
    ("425A6839", "bzip2", "bzip2"),
    ("FD377A585A00", "xz", "xz"),
    ("04224D18", "lz4", "lz4"),
    ("789C0304", "zlib", "zlib"),
    ("894844460D0A1A0A", "hdf5", "hdf5"),
    ("504B0304", "zip", "zip"),
    ("7B226122", "safetensors", "safetensors"),
    ("47475546", "gguf", "gguf"),
    ("47474A54", "ggml", "ggml"),
    ("00112233", "unknown", "unknown"),
    ("934E554D505901", "numpy", "numpy"),
    ("6F6F6E6E7800", "onnx", "onnx"),
    ("08011200", "onnx", "onnx"),
    ("43424D31", "catboost", "catboost"),
    ("524B4E4E", "rknn", "rknn"),
    ("54370000", "torch7", "torch7"),
    (_x("RDX3\n"), "r_serialized", "r_serialized"),
    (_x("cos\nsystem\n(S'id'\ntR."), "unknown", "pickle"),
    (_x("#cos\nsystem\n(S'id'\ntR."), "unknown", "pickle"),
    (_x('<?xml version="1.0"?><PMML>'), "unknown", "pmml"),
    (_x('<?xml?><net name="a">'), "unknown", "openvino"),
    (_x("\x14\0\0\0\0\0\0\0" + '{"w": {"dtype": "F32"}}xx'), "unknown", "safetensors"),
    (_x("luaT nn.Linear"), "unknown", "torch7"),
    (_x("tree\nversion=v3\nnum_class=1\nmax_feature_idx=3\ntree=0\nnum_leaves=2\n"), "unknown", "lightgbm"),
    ("420043004E000000", "cntk", "cntk"),
    (_x("\n\x07version 1\n\x03uid CompositeFunction"), "unknown", "cntk"),
    ("4142", "unknown", "unknown"),
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    tail = F.element_at(F.array(*[F.lit(t) for t in _TAILS]), (i % len(_TAILS) + 1).cast("int"))
    head = F.element_at(F.array(*[F.lit(h) for h, _, _ in _HEADS]), (i % len(_HEADS) + 1).cast("int"))
    path = F.concat(F.lit("/data/"), "source", F.lit("/m"), i.cast("string"), tail)
    files = table(spark, sf_dir, "documents").select("doc_id", "source", "text", "n_chars", path.alias("path"), F.unhex(head).alias("content"), head.alias("head"))
    return files.withColumn("length", F.octet_length("content").cast("long"))


_FILES = f"""heads AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {', '.join(f"('{h}', '{m}', '{c}')" for h, m, c in _HEADS)}) t(head, by_magic, by_content)),
files AS (SELECT doc_id, source, text, n_chars, '/data/' || source || '/m' || doc_id || ([{_values(_TAILS)}])[(doc_id % {len(_TAILS)}) + 1] AS path, head, by_magic, by_content FROM documents JOIN heads ON k = doc_id % {len(_HEADS)}),
named AS (SELECT *, split_part(path, '/', -1) AS name FROM files), parts AS (SELECT *, lower(regexp_extract(name, '[^.].*?(\\.[^.]*)$', 1)) AS ext FROM named)"""
_ENDS_TAR = "(" + " OR ".join(f"ends_with(lower(path), '{e}')" for e in K.TARS) + ")"
_EXT_SQL = f"CASE WHEN {_ENDS_TAR} THEN 'tar' WHEN ends_with(lower(path), '-symbol.json') THEN 'mxnet' " + " ".join(f"WHEN ext = '{e}' THEN '{f}'" for e, f in T.NAME_FORMATS.items()) + " ELSE 'unknown' END"


def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, p, c, n = K.with_proto_pickle(_files(spark, sf_dir)), F.col("path"), F.col("content"), F.col("length")
    return files.select("doc_id", "path", "content", "length", "proto_pickle", "n_chars", K.format_from_magic(c).alias("by_magic"), K.format_from_extension(p).alias("by_name"), K.format_from_content(p, c, n, F.col("proto_pickle")).alias("by_content"))


@_add(f"WITH {_FILES} SELECT doc_id, by_magic, by_content, {_EXT_SQL} AS by_name FROM parts")
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats(spark, sf_dir).select("doc_id", "by_magic", "by_content", "by_name")


_PAIRS = ", ".join(f"('{n}', '{c}')" for n, allowed in K.AGREE.items() for c in allowed)
_AGREE_SQL = f"""CASE WHEN by_name IN ({_values(K.ANY_CONTENT)}) OR len(head) < 8 THEN true
 WHEN by_name = 'tar' THEN by_content = 'tar' OR (regexp_matches(lower(path), '\\.(tar\\.gz|tgz)$') AND by_content = 'gzip') OR (regexp_matches(lower(path), '\\.(tar\\.bz2|tbz2)$') AND by_content = 'bzip2') OR (regexp_matches(lower(path), '\\.(tar\\.xz|txz)$') AND by_content = 'xz')
 WHEN by_name = 'compressed' THEN (ext, by_content) IN (('.gz', 'gzip'), ('.bz2', 'bzip2'), ('.xz', 'xz'), ('.lz4', 'lz4'), ('.zlib', 'zlib'))
 WHEN by_name = 'numpy' THEN by_content = 'numpy' OR (ext = '.npz' AND by_content = 'zip')
 WHEN by_name IN ({_values(list(K.AGREE))}) THEN (by_name, by_content) IN ({_PAIRS}) ELSE by_content <> 'unknown' AND by_content = by_name END"""


@_add(f"WITH {_FILES}, f AS (SELECT *, {_EXT_SQL} AS by_name FROM parts) SELECT by_name, by_content, count(*) AS n_files FROM f WHERE NOT ({_AGREE_SQL}) GROUP BY ALL")
def format_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _formats(spark, sf_dir)
    return f.where(~K.agrees(F.col("path"), F.col("by_name"), F.col("by_content"), F.col("length"))).groupBy("by_name", "by_content").agg(F.count("*").alias("n_files"))


#: By hand: ending, first bytes, the format that decides the parser, and the scanner.
_DISPATCH = [
    (".pt", "504B0304", "zip", "pytorch_zip"),
    (".bin", "504B0304", "zip", "pickle"),
    (".keras", "504B0304", "zip", "keras_zip"),
    (".mar", "504B0304", "torchserve_mar", "torchserve_mar"),
    (".zip", "504B0304", "zip", "zip"),
    (".bin", "00112233", "pytorch_binary", "pytorch_binary"),
    (".bin", _x("cos\nsystem\n(S'id'\ntR."), "pickle", "pickle"),
    (".bin", "7B226122", "safetensors", "safetensors"),
    (".ckpt", "00112233", "pickle", "pickle"),
    (".h5", "894844460D0A1A0A", "hdf5", "keras_h5"),
    (".pkl", "894844460D0A1A0A", "hdf5", "keras_h5"),
    (".gguf", "00112233", "gguf", "gguf"),
    (".ggml", "47475546", "gguf", "gguf"),
    (".gz", "1F8B0800", "compressed", "compressed"),
    (".gz", "00112233", "unknown", "compressed"),
    (".tar.gz", "1F8B0800", "tar", "tar"),
    (".json", "7B226122", "unknown", "metadata"),
    (".md", "00112233", "unknown", "metadata"),
    (".xyz", "00112233", "unknown", "unknown"),
    (".pb", "00112233", "protobuf", "tf_savedmodel"),
    (".pkl", "4142", "unknown", "pickle"),
    (".txt", "8004950000", "pickle", "pickle"),
    (".t7", _x("luaT nn.Linear"), "torch7", "torch7"),
    (".t7", "00112233", "unknown", "torch7"),
]


@_add(f"SELECT doc_id, t, f AS format, s AS scanner FROM documents JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {', '.join(str(x) for x in _DISPATCH)}) v(t, h, f, s)) ON k = doc_id % {len(_DISPATCH)}")
def dispatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda n: F.element_at(F.array(*[F.lit(x[n]) for x in _DISPATCH]), (F.col("doc_id") % len(_DISPATCH) + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("t"), F.concat(F.lit("/m/x"), pick(0)).alias("path"), F.unhex(pick(1)).alias("content"))
    files = K.with_proto_pickle(files).withColumn("length", F.octet_length("content").cast("long"))
    out = files.withColumn("format", K.file_format(F.col("path"), F.col("content"), F.col("length"), F.col("proto_pickle")))
    return out.select("doc_id", "t", "format", K.scanner_of(F.col("path"), F.col("format")).alias("scanner"))


_META = f"(ext IN ({_values(K.METADATA_EXTENSIONS)}) OR lower(name) IN ({_values(K.METADATA_NAMES)}) OR (ext = '.txt' AND starts_with(lower(name), 'readme.')))"


@_add(f"""WITH {_FILES} SELECT doc_id, path FROM parts WHERE {_META} OR NOT (ext IN ({_values(T.SKIP_EXTENSIONS)})
OR (starts_with(name, '.') AND ext NOT IN ({_values(K.HIDDEN_MODELS)})) OR name IN ({_values(T.SKIP_NAMES)}))""")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(~K.skipped(F.col("path"))).select("doc_id", "path")


@_add(f"""WITH {_FILES}, s AS (SELECT doc_id, name, string_split(lower(regexp_extract(name, '^\\.?[^.]*\\.(.*)$', 1)), '.') AS l FROM parts WHERE contains(substring(name, 2), '.'))
SELECT doc_id FROM s WHERE len(list_filter(range(1, len(l) + 1), lambda i: list_contains([{_values(T.SCANNABLE)}], '.' || array_to_string(l[i:], '.')))) > 0""")
def scannable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(K.scannable(F.col("path"))).select("doc_id")


@_add(f"WITH {_FILES} SELECT doc_id, path, NOT contains(path, '/../') AS inside, replace(path, '/m' || doc_id || '/..', '') AS resolved FROM files")
def contained_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.concat(F.lit("/data/./"), "source", F.lit("//m"), F.col("doc_id").cast("string"))
    path = F.col("path")
    beside = F.when(F.contains(path, F.lit("/../")), path).otherwise(F.concat(base, F.lit("/"), K.file_name(path)))
    return _files(spark, sf_dir).select("doc_id", "path", K.within(base, beside).alias("inside"), K.resolved(path).alias("resolved"))


@_add(f"WITH {_FILES} SELECT doc_id FROM parts WHERE ends_with(name, '.lock') OR ends_with(name, '.metadata') OR name IN ({_values(K.CACHE_NAMES)})")
def cache_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).where(K.cache_file(F.col("path"))).select("doc_id")


@_add(f"""WITH {_FILES} SELECT doc_id, CASE WHEN ext IN ({_values(T.COMPONENT_EXTENSIONS)}) THEN 'machine-learning-model' WHEN ext IN ('.zip', '.tar', '.gz', '.7z', '.bz2') THEN 'container'
WHEN ext IN ('.json', '.yaml', '.yml', '.xml', '.csv', '.txt', '.md') THEN 'data' ELSE 'file' END AS component FROM parts""")
def component_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).select("doc_id", K.component_type(F.col("path")).alias("component"))


def _by_hand(spark: SparkSession, sf_dir: str, values: list[str], name: str) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("doc_id") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias(name))


def _by_hand_sql(rows: str, columns: str, n: int) -> str:
    return f"SELECT doc_id, {columns} FROM documents JOIN (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {rows}) t({columns})) ON k = doc_id % {n}"


_ENTRIES = ["a/b.txt", "../x", "a/../../x", "/etc/passwd", "C:\\x", "a/../b", "./a", "..\\..\\w", "a/b/../../c", "/usr//lib/x", "/home/x", "c:\\windows\\System32", "/ETC"]


@_add(_by_hand_sql("""('a/b.txt', true, false), ('../x', false, false), ('a/../../x', false, false), ('/etc/passwd', false, true), ('C:\\x', false, false), ('a/../b', true, false),
('./a', true, false), ('..\\..\\w', false, false), ('a/b/../../c', true, false), ('/usr//lib/x', false, true), ('/home/x', false, false), ('c:\\windows\\System32', false, true), ('/ETC', false, true)""", "entry, is_safe, is_system", 13))
def member_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_hand(spark, sf_dir, _ENTRIES, "entry").select("doc_id", "entry", K.safe_member(F.col("entry")).alias("is_safe"), K.system_path(F.col("entry")).alias("is_system"))


_VERSIONS = ["2.5.1", "2.6.0", "2.6.0rc1", "2.10.0", "1.13", "dev", "2.6.1", "3.0"]


@_add(_by_hand_sql("('2.5.1', true), ('2.6.0', false), ('2.6.0rc1', true), ('2.10.0', false), ('1.13', true), ('dev', true), ('2.6.1', false), ('3.0', false)", "version, is_vulnerable", 8))
def version_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_hand(spark, sf_dir, _VERSIONS, "version").select("doc_id", "version", K.vulnerable(F.col("version"), 2, 6, 0).alias("is_vulnerable"))


@_add(_by_hand_sql("('10GB', 10737418240, '10.0 GB'), ('1.5MB', 1572864, '1.5 MB'), ('512', 512, '512.0 B'), ('2 KB', 2048, '2.0 KB'), ('x', NULL, NULL), ('3TB', 3298534883328, '3.0 TB')", "said, bytes, shown", 6))
def parsed_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _by_hand(spark, sf_dir, ["10GB", "1.5MB", "512", "2 KB", "x", "3TB"], "said").withColumn("bytes", K.size_in_bytes(F.col("said")))
    return rows.withColumn("shown", F.when(F.col("bytes").isNotNull(), K.size_text(F.col("bytes"))))


_TENSORS = """tensors AS (SELECT l_orderkey AS file_id, l_linenumber AS n, CASE l_linenumber % 3 WHEN 0 THEN 'F32' WHEN 1 THEN 'I64' ELSE 'F16' END AS dtype,
l_quantity::BIGINT AS width, l_linenumber::BIGINT * 100 AS begin_at, l_linenumber::BIGINT * 100 + CASE WHEN l_quantity > 25 THEN 100 ELSE 90 END AS end_at FROM lineitem)"""


def _tensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber").cast("long"), F.col("l_quantity")
    dtype = F.when(n % 3 == 0, "F32").when(n % 3 == 1, "I64").otherwise("F16")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), n.alias("n"), dtype.alias("dtype"), q.cast("long").alias("width"), (n * 100).alias("begin_at"), (n * 100 + F.when(q > 25, 100).otherwise(90)).alias("end_at"))


@_add(f"WITH {_TENSORS} SELECT file_id, sum(3 * width * CASE dtype WHEN 'F32' THEN 4 WHEN 'I64' THEN 8 ELSE 2 END)::BIGINT AS total FROM tensors GROUP BY file_id")
def tensor_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = K.tensor_bytes(F.array(F.lit(3).cast("long"), F.col("width")), F.col("dtype"))
    return _tensors(spark, sf_dir).groupBy("file_id").agg(F.sum(size).alias("total"))


@_add(f"WITH {_TENSORS} SELECT file_id, begin_at AS \"begin\", expected FROM (SELECT *, lag(end_at, 1, 0::BIGINT) OVER (PARTITION BY file_id ORDER BY begin_at) AS expected FROM (SELECT file_id, begin_at, max(end_at) AS end_at FROM tensors GROUP BY ALL)) WHERE begin_at <> expected")
def tensor_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.gaps(_tensors(spark, sf_dir).groupBy("file_id", "begin_at").agg(F.max("end_at").alias("end_at")), "file_id", "begin_at", "end_at")


@_add("""SELECT l_orderkey AS file_id, l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::BIGINT * 2 WHEN 1 THEN (l_quantity::BIGINT + 31) // 32 * 18
WHEN 2 THEN NULL ELSE 256 * l_quantity::BIGINT // 256 * 210 END AS bytes, CASE l_linenumber % 4 WHEN 1 THEN l_quantity::BIGINT % 32 = 0 WHEN 2 THEN NULL ELSE true END AS aligned FROM lineitem""")
def ggml_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    kind = F.when(n % 4 == 0, 1).when(n % 4 == 1, 2).when(n % 4 == 2, 99).otherwise(14)
    elements = F.when(n % 4 == 3, q * 256).otherwise(q)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), n.alias("n"), K.ggml_bytes(kind, elements).alias("bytes"), K.ggml_aligned(kind, elements).alias("aligned"))


_TENSOR_NAMES = ["model.layers.0.weight", "../up", "a<SCRIPT", "x.eval(", "bias", "p\\u0041"]


@_add(_by_hand_sql("('model.layers.0.weight', false), ('../up', true), ('a<SCRIPT', true), ('x.eval(', true), ('bias', false), ('p\\u0041', true)", "tensor, suspicious", 6))
def tensor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_hand(spark, sf_dir, _TENSOR_NAMES, "tensor").select("doc_id", "tensor", K.suspicious_tensor_name(F.col("tensor")).alias("suspicious"))


# opcodes: events of a user in order
_NAMES = {"click": ["GLOBAL", "STACK_GLOBAL", "INST", "DUP"], "purchase": ["REDUCE", "REDUCE", "BUILD_TUPLE", "ROT"], "view": ["SETITEM", "SETITEMS", "GLOBAL", "BUILD_LIST"], "signup": ["NEWOBJ", "REDUCE", "BUILD_STRING", "NEWOBJ"]}
_OPS = "ops AS (SELECT user_id AS file_id, event_id AS idx, CASE event_type " + " ".join(f"WHEN '{k}' THEN ([{_values(v)}])[(event_id % 4 + 1)::INT]" for k, v in _NAMES.items()) + " ELSE 'STOP' END AS name FROM events)"


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F
    for k, v in _NAMES.items():
        name = name.when(F.col("event_type") == k, F.element_at(F.array(*[F.lit(x) for x in v]), (F.col("event_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.col("event_id").alias("idx"), name.otherwise("STOP").alias("name"))


def _suffix(pattern: list[str]) -> str:
    return " AND ".join(f"{'name' if i == 0 else f'p{i}'} = '{x}'" for i, x in enumerate(reversed(pattern)))


_PRIOR = "l AS (SELECT file_id, idx, name, lag(name) OVER w AS p1, lag(name, 2) OVER w AS p2, lag(name, 3) OVER w AS p3 FROM ops WINDOW w AS (PARTITION BY file_id ORDER BY idx))"


@_add(f"WITH {_OPS}, {_PRIOR} " + " UNION ALL ".join(f"SELECT file_id, idx, '{n}' AS pattern, '{s}' AS severity FROM l WHERE {_suffix(p)}" for n, p, s in T.OPCODE_PATTERNS))
def opcode_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.suffix_matches(_ops(spark, sf_dir), [(n, p) for n, p, _ in T.OPCODE_PATTERNS], "file_id", "idx", "name")
    severity = F
    for n, _, s in T.OPCODE_PATTERNS:
        severity = severity.when(F.col("pattern") == n, F.lit(s))
    return found.withColumn("severity", severity)


@_add(f"""WITH {_OPS}, s AS (SELECT *, coalesce(sum((name = 'STOP')::INT) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream FROM ops)
SELECT file_id, stream, count(*) AS n FROM s GROUP BY ALL""")
def opcode_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.stream_ids(_ops(spark, sf_dir), "file_id", "idx", "name", "STOP").groupBy("file_id", "stream").agg(F.count("*").alias("n"))


_DEPTH = "CASE WHEN name IN ('GLOBAL', 'NEWOBJ') THEN 1 WHEN name = 'STOP' THEN 0 ELSE -1 END"


@_add(f"""WITH RECURSIVE {_OPS}, o AS (SELECT file_id, name, row_number() OVER (PARTITION BY file_id ORDER BY idx) AS n FROM ops),
d AS (SELECT file_id, n, CASE WHEN name = 'STOP' THEN 0 ELSE greatest(0, {_DEPTH}) END AS depth FROM o WHERE n = 1
 UNION ALL SELECT o.file_id, o.n, CASE WHEN name = 'STOP' THEN 0 ELSE greatest(0, depth + {_DEPTH}) END FROM d JOIN o ON o.file_id = d.file_id AND o.n = d.n + 1)
SELECT file_id, arg_max(depth, n)::BIGINT AS depth, max(depth)::BIGINT AS deepest FROM d GROUP BY file_id""")
def stack_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.when(F.col("name").isin("GLOBAL", "NEWOBJ"), 1).otherwise(-1)
    return S.final_depth(_ops(spark, sf_dir), "file_id", "idx", change, F.col("name") == "STOP")


@_add(f"""WITH {_OPS}, g AS (SELECT file_id, idx, name, CASE WHEN name IN ('NEWOBJ', 'SETITEM') THEN name || idx END AS said FROM ops),
p AS (SELECT *, list_reverse(list_filter(array_agg(said) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda x: x IS NOT NULL)) AS said_before FROM g)
SELECT file_id, idx, said_before[2] AS module, said_before[1] AS function FROM p WHERE name = 'STACK_GLOBAL'""")
def stack_globals(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("name").isin("NEWOBJ", "SETITEM"), F.concat("name", F.col("idx").cast("string")))
    return S.last_strings(_ops(spark, sf_dir).withColumn("said", said), "file_id", "idx", "said", F.col("name") == "STACK_GLOBAL")


@_add(f"WITH {_OPS} SELECT file_id, idx, string_agg(name, ' ') OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM ops")
def neighbour_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbours(_ops(spark, sf_dir), "file_id", "idx", "name", 2)


@_add(f"""WITH {_OPS}, a AS (SELECT *, max((name = 'STOP')::INT) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS ahead FROM ops)
SELECT file_id, min(idx) AS "at" FROM a WHERE name = 'NEWOBJ' AND ahead = 1 GROUP BY file_id""")
def decode_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.followed(_ops(spark, sf_dir), "file_id", "idx", F.col("name") == "NEWOBJ", F.col("name") == "STOP")


@_add(f"""WITH {_OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY idx) - row_number() OVER (PARTITION BY file_id, name ORDER BY idx) AS g FROM ops)
SELECT file_id, name, min(idx) AS start, count(*) AS length FROM r GROUP BY file_id, name, g HAVING count(*) >= 3""")
def opcode_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(_ops(spark, sf_dir), "file_id", "idx", "name", 3)


@_add(f"""WITH {_OPS}, c AS (SELECT *, sum((name = 'REDUCE')::INT) OVER (PARTITION BY file_id ORDER BY idx) AS k FROM ops) SELECT file_id, idx FROM c WHERE name = 'REDUCE' AND k % 5 = 0""")
def opcode_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.alerts(_ops(spark, sf_dir), "file_id", "idx", F.col("name") == "REDUCE", 4)


@_add(f"WITH {_FILES}, g AS (SELECT sha256(text) AS content_hash, list(path ORDER BY path) AS l, min(path) AS first_path FROM files GROUP BY ALL) SELECT content_hash, len(l)::BIGINT AS n_files, array_to_string(l, ' ') AS location, first_path FROM g")
def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.content_groups(_files(spark, sf_dir), "path", "text").select("content_hash", "n_files", "location", "first_path")


@_add("SELECT sha256(string_agg(sha256(text), '' ORDER BY sha256(text))) AS aggregate_hash, count(*) AS n_files FROM documents")
def aggregate_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.aggregate_hash(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h")), "h")


@_add(f"WITH {_FILES} SELECT doc_id, path FROM files QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1")
def representative_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.representatives(_files(spark, sf_dir), "path", "text").select("doc_id", "path")


_SHARD_NAMES = ["pytorch_model-{:05d}-of-00009.bin", "model-{:05d}-of-00002.safetensors", "model.ckpt-{}.data-0-of-1", "model_weights_{}.h5", "checkpoint_{}.pt", "params_shard_{}.bin", "pytorch_model.bin", "x_model-{}-of-3.bin"]
_SHARD_PATH = "'/s/' || source || '/' || CASE doc_id % 8 " + " ".join("WHEN {} THEN {}".format(i, "'" + n.replace("{:05d}", "' || lpad(doc_id::VARCHAR, 7, '0') || '").replace("{}", "' || doc_id || '") + "'") for i, n in enumerate(_SHARD_NAMES)) + " END"


@_add(f"""WITH f AS (SELECT source, split_part({_SHARD_PATH}, '/', -1) AS name, {_SHARD_PATH} AS path, n_chars FROM documents),
s AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(name, '^{p}') THEN {i}" for i, p in enumerate(T.SHARDS))} END AS pattern FROM f)
SELECT '/s/' || source AS dir, pattern, count(*) AS total_shards, sum(n_chars)::BIGINT AS total_size, min(path) AS first_shard FROM s WHERE pattern IS NOT NULL GROUP BY source, pattern""")
def shard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, name = F.col("doc_id"), F
    for k, n in enumerate(_SHARD_NAMES):
        before, _, after = n.replace("{:05d}", "{}").partition("{}")
        number = F.lpad(i.cast("string"), 7, "0") if "05d" in n else i.cast("string")
        name = name.when(i % 8 == k, F.concat(F.lit(before), number, F.lit(after)) if "{" in n else F.lit(n))
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/s/"), "source", F.lit("/"), name).alias("path"), F.col("n_chars").alias("length"))
    return G.shard_groups(files)


@_add(f"""WITH {_FILES}, f AS (SELECT n_chars, {_EXT_SQL} AS format FROM parts) SELECT format, count(*) AS n, sum(n_chars)::BIGINT AS total_size FROM f GROUP BY format""")
def format_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy(K.format_from_extension(F.col("path")).alias("format")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("total_size"))


_NOW = 1_800_000_000
_CACHE = f"""files AS (SELECT doc_id, md5(text) AS h, n_chars AS size, {_NOW} - doc_id % 50 AS mtime FROM documents),
cache AS (SELECT h, min(size + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS size, min(mtime + CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 0.5 END)::DOUBLE AS mtime, min({_NOW} - (doc_id % 40) * 86400) AS scanned_at FROM files WHERE doc_id % 4 <> 0 GROUP BY h),
l AS (SELECT doc_id, CASE WHEN cache.h IS NULL THEN 'not_found' WHEN abs(files.mtime - cache.mtime) > 1 OR files.size <> cache.size OR {_NOW} - scanned_at > 30 * 86400 THEN 'invalid' ELSE 'hit' END AS state FROM files LEFT JOIN cache USING (h))"""


def _cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"), F.col("n_chars").alias("size"), (F.lit(_NOW) - i % 50).cast("double").alias("mtime"))
    cache = files.where(i % 4 != 0).groupBy("h").agg(F.min(F.col("size") + F.when(i % 7 == 0, 1).otherwise(0)).alias("size"), F.min(F.col("mtime") + F.when(i % 5 == 0, 2).otherwise(0.5)).alias("mtime"), F.min(F.lit(_NOW) - (i % 40) * 86400).cast("double").alias("scanned_at"))
    return G.cache_lookup(files, cache, "h", F.lit(float(_NOW)))


@_add(f"WITH {_CACHE} SELECT doc_id, state FROM l")
def cache_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cached(spark, sf_dir).select("doc_id", "state")


@_add(f"WITH {_CACHE} SELECT count(*) FILTER (state = 'hit') AS hits, count(*) FILTER (state <> 'hit') AS misses, round(avg((state = 'hit')::INT), 6)::DOUBLE AS hit_rate FROM l")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("state") == "hit"
    return _cached(spark, sf_dir).agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.avg(hit.cast("double")), 6).alias("hit_rate"))


@_add("SELECT event_id, user_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", "user_id", k.alias("k")).where("k is not null")


@_add(f"""WITH {_FILES}, d AS (SELECT doc_id, path, ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, text, name FROM parts),
l AS (SELECT DISTINCT dir FROM d WHERE lower(name) IN ({_values(T.LICENSE_FILES)})),
h AS (SELECT doc_id, array_to_string(string_split(text, chr(10))[1:10], chr(10)) AS head FROM d)
SELECT doc_id, path FROM d JOIN h USING (doc_id) WHERE ext IN ({_values(T.DATA_EXTENSIONS)}) AND dir NOT IN (SELECT dir FROM l) AND NOT regexp_matches(head, {quoted('(?im)' + '|'.join(f'(?:{p})' for p, _, _, _ in T.LICENSES))})""")
def unlicensed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unlicensed(_files(spark, sf_dir).select("doc_id", "path", "text"), "path", "text").select("doc_id", "path")


@_add(f"WITH {_FILES}, p AS (SELECT doc_id, path FROM files) SELECT a.doc_id, a.path FROM p a WHERE ends_with(a.path, '.csv') AND NOT EXISTS (SELECT 1 FROM p b WHERE b.path = replace(a.path, '.csv', '.pmml'))")
def missing_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("doc_id", "path")
    return G.without_companion(files.where(F.endswith("path", F.lit(".csv"))), files, "path", F.regexp_replace("path", r"\.csv$", ".pmml"))


@_add("SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.hashes(table(spark, sf_dir, "documents"), "text").select("doc_id", "md5", "sha256")


@_add("""SELECT user_id, (count(*) > 0)::INT AS any_event, count(DISTINCT event_type) AS n_categories, bool_or(event_type = 'error') AND bool_or(event_type = 'purchase') AS correlated FROM events GROUP BY user_id""")
def signal_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.lit(1).alias("any_event"), F.count_distinct(t).alias("n_categories"), (F.bool_or(t == "error") & F.bool_or(t == "purchase")).alias("correlated"))


_WEIGHT = "CASE severity WHEN 'critical' THEN 5 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"
_LEVEL = "CASE severity WHEN 'critical' THEN 'error' WHEN 'info' THEN 'note' WHEN 'debug' THEN 'none' ELSE 'warning' END"
_RANK = "CASE severity WHEN 'critical' THEN 90 WHEN 'warning' THEN 60 WHEN 'info' THEN 30 WHEN 'debug' THEN 10 ELSE 50 END::DOUBLE"
_WORDS = ["pickle", "import: os", "eval network", "secret", "CVE license", "plain"]


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in _WORDS]), (F.col("seq") % len(_WORDS) + 1).cast("int"))
    rows = checks(spark, sf_dir).where("status = 'failed' and severity is not null").withColumn("message", F.concat("message", F.lit(" "), word))
    return rows.withColumns({"asset": asset_of(F.col("location")), "type": F.when(F.col("seq") % 5 == 0, F.concat("name", F.lit(" kind_x")))})


_ISSUES = f"""{CHECKS}, i0 AS (SELECT seq, name, severity, location, why, rule_code, message || ' ' || ([{', '.join(map(quoted, _WORDS))}])[(seq % {len(_WORDS)} + 1)::INT] AS message, CASE WHEN seq % 5 = 0 THEN name || ' kind_x' END AS type FROM checks WHERE status = 'failed' AND severity IS NOT NULL),
i AS (SELECT *, CASE WHEN type IS NOT NULL THEN 'MA' || upper(replace(type, ' ', '-')) ELSE 'MA-' || regexp_replace(upper(replace(replace(left(message, 30), ' ', '-'), ':', '')), '[^\\p{{L}}\\p{{N}}-]', '', 'g') END AS rule_id FROM i0)"""


@_add(f"""WITH {_ISSUES} SELECT seq, rule_id, {_LEVEL} AS level, {_RANK} AS rank, CASE WHEN severity IN ('critical', 'warning') THEN 'fail' ELSE 'informational' END AS kind, message,
replace(replace(replace(replace(location, ' ', '%20'), '(', '%28'), ')', '%29'), ':', '%3A') AS uri, left(sha256(message || location || severity), 16) AS fingerprint FROM i""")
def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_results(_issues(spark, sf_dir))


_SHORT = "CASE WHEN contains(low, 'pickle') THEN 'Potentially unsafe pickle operation detected' WHEN contains(low, 'import') THEN 'Dangerous import statement found' WHEN contains(low, 'exec') OR contains(low, 'eval') THEN 'Code execution vulnerability' WHEN contains(low, 'network') THEN 'Network communication detected' WHEN contains(low, 'secret') OR contains(low, 'key') THEN 'Potential secrets or keys exposed' WHEN contains(low, 'license') THEN 'License compliance issue' WHEN contains(low, 'blacklist') THEN 'Blacklisted model name detected' ELSE left(message, 100) END"
_TAGS = "'security,ml-model' || CASE WHEN contains(low, 'pickle') THEN ',pickle,deserialization' ELSE '' END || CASE WHEN contains(low, 'import') OR contains(low, 'exec') OR contains(low, 'eval') THEN ',code-execution' ELSE '' END || CASE WHEN contains(low, 'network') THEN ',network' ELSE '' END || CASE WHEN contains(low, 'secret') OR contains(low, 'key') THEN ',secrets' ELSE '' END || CASE WHEN contains(low, 'license') THEN ',license' ELSE '' END || CASE WHEN contains(low, 'cve') THEN ',vulnerability' ELSE '' END"


@_add(f"""WITH {_ISSUES}, f AS (SELECT *, lower(message) AS low FROM i QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY seq) = 1)
SELECT seq, rule_id, CASE WHEN type IS NOT NULL THEN upper(left(name, 1)) || substring(name, 2) || ' Kind X' WHEN contains(message, ':') THEN split_part(message, ':', 1) ELSE left(message, 50) END AS name,
{_SHORT} AS short, {_SHORT} || coalesce(' ' || why, '') AS "full", {_LEVEL} AS level, {_RANK} AS rank, {_TAGS} AS tags FROM f""")
def sarif_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sarif_rules(_issues(spark, sf_dir)).withColumn("tags", F.array_join("tags", ","))


@_add(f"""WITH {CHECKS}, k AS (SELECT asset, least(sum({_WEIGHT}), 10)::BIGINT AS risk FROM assets WHERE status = 'failed' AND severity IS NOT NULL GROUP BY asset),
f AS (SELECT '/models/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.zip' ELSE '.pkl' END AS path, n_chars AS size FROM documents)
SELECT path, CASE WHEN ends_with(path, '.zip') THEN 'container' ELSE 'machine-learning-model' END AS type, size, coalesce(risk, 0)::BIGINT AS risk, '{{"size":' || size || ',"risk":' || coalesce(risk, 0) || '}}' AS properties FROM f LEFT JOIN k ON path = asset""")
def sbom_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("/models/"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 4 == 0, ".zip").otherwise(".pkl")).alias("path"), F.col("n_chars").alias("size"))
    return reports.components(files, _issues(spark, sf_dir)).select("path", "type", "size", "risk", "properties")
