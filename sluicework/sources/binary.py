"""Files as rows, and the parsers that turn their bytes into rows. Nothing is ever loaded or executed.

Parsers run as Arrow batches and never raise: what can't be read gives a row
with an error.
"""

from __future__ import annotations

import ast
import base64
import bz2
import gzip
import io
import json
import lzma
import math
import pickletools
import re
import struct
import tarfile
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 5
MAX_ENTRIES = 10_000
MAX_OPCODES = 1_000_000
MAX_MEMBER_BYTES = 1 << 28
MAX_TOTAL_BYTES = 1 << 32


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of all files under a folder, by any store that Spark reads."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def read_file_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)


SLICE = 4096


def _rows(files: DataFrame, parse, schema: str) -> DataFrame:
    """Rows that ``parse(bytes)`` gives for each file, after its path, in slices of bounded size."""
    names = [c.split()[0] for c in schema.split(", ")]

    def given(content: bytes):
        try:
            yield from parse(content)
        except Exception as e:  # a broken file is a row, not a failure of the job
            yield {"error": f"{type(e).__name__}: {e}"[:200]}

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = given(content.as_py() or b"")
                while part := _slice(rows):
                    columns = [pa.array([path.as_py()] * len(part), pa.string()), *(pa.array([r.get(n) for r in part], kinds[n]) for n in names)]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", *names])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: to_arrow_type(f.dataType) for f in _parse_datatype_string(schema).fields}
    return files.select("path", "content").mapInArrow(run, f"path string, {schema}")


def _slice(rows) -> list[dict]:
    """The next rows: SLICE of them, or fewer if they hold many bytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r.get("content") or b"")
        if len(out) >= SLICE or size > MAX_MEMBER_BYTES // 8:
            break
    return out


def safetensors(files: DataFrame) -> DataFrame:
    """path, name, dtype, shape, begin, end, error: the tensors of SafeTensors headers."""

    def parse(data: bytes):
        (size,) = struct.unpack_from("<Q", data)
        if size > len(data) - 8:
            raise ValueError("header is longer than the file")
        for name, t in json.loads(data[8 : 8 + size]).items():
            if name != "__metadata__":
                begin, end = t["data_offsets"]
                yield {"name": name, "dtype": t["dtype"], "shape": t["shape"], "begin": begin, "end": end, "error": None if 0 <= begin <= end <= len(data) - 8 - size else "offsets out of bounds"}

    return _rows(files, parse, "name string, dtype string, shape array<bigint>, begin bigint, end bigint, error string")


#: Sizes of the scalar kinds of GGUF metadata by number; 8 is a string and 9 an array.
GGUF_SCALARS = {0: "<B", 1: "<b", 2: "<H", 3: "<h", 4: "<I", 5: "<i", 6: "<f", 7: "<?", 10: "<Q", 11: "<q", 12: "<d"}


class _Gguf:
    """Reads a GGUF file's parts one after another."""

    def __init__(self, data: bytes):
        if data[:4] != b"GGUF":
            raise ValueError("no GGUF file")
        self.data, self.at = data, 24
        _, self.tensors, self.pairs = struct.unpack_from("<IQQ", data, 4)

    def number(self, form: str):
        (out,) = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def text(self) -> str:
        n = self.number("<Q")
        self.at += n
        if self.at > len(self.data):
            raise ValueError("string beyond the end")
        return self.data[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.number("<I"), self.number("<Q")
            if n > len(self.data):
                raise ValueError("array beyond the end")
            return [self.value(inner) for _ in range(n)]
        return self.number(GGUF_SCALARS[kind])

    def pair(self):
        key, kind = self.text(), self.number("<I")
        return key, kind, self.value(kind)


def gguf(files: DataFrame) -> DataFrame:
    """path, key, kind, value, error: the metadata of GGUF files; an array is JSON."""

    def parse(data: bytes):
        file = _Gguf(data)
        yield {"key": "n_tensors", "kind": -1, "value": str(file.tensors)}
        for _ in range(file.pairs):
            key, kind, value = file.pair()
            yield {"key": key, "kind": kind, "value": json.dumps(value) if kind == 9 else str(value)}

    return _rows(files, parse, "key string, kind int, value string, error string")


def gguf_tensors(files: DataFrame) -> DataFrame:
    """path, idx, name, dims, kind, offset, data_start, alignment, length, error: the tensors of GGUF files; offsets count from data_start."""

    def parse(data: bytes):
        file, alignment, tensors = _Gguf(data), 32, []
        for _ in range(file.pairs):
            key, _, value = file.pair()
            if key == "general.alignment":
                alignment = max(1, int(value))
        for _ in range(file.tensors):
            name, n = file.text(), file.number("<I")
            if n > 64:
                raise ValueError("too many dimensions")
            dims = [file.number("<Q") for _ in range(n)]
            tensors.append((name, dims, file.number("<I"), file.number("<Q")))
        start = -(-file.at // alignment) * alignment
        for i, (name, dims, kind, offset) in enumerate(tensors):
            wrong = "dimension out of range" if any(d <= 0 or d > 1 << 31 for d in dims) else "data beyond the end" if start > len(data) else None
            yield {"idx": i, "name": name, "dims": [min(d, 1 << 62) for d in dims], "kind": kind, "offset": min(offset, 1 << 62), "data_start": start, "alignment": alignment, "length": len(data), "error": wrong}

    return _rows(files, parse, "idx bigint, name string, dims array<bigint>, kind int, offset bigint, data_start bigint, alignment bigint, length bigint, error string")


def looks_like_pickle(data: bytes) -> bool:
    """Whether at least three opcodes, two of them structural, can be read among the first twenty."""
    if len(data) < 2 or (data[0] == 0x80 and data[1] not in (2, 3, 4, 5)) or (data[0] != 0x80 and data[:1] not in PICKLE_STARTS):
        return False
    known = 0
    try:
        for n, (op, _, _) in enumerate(pickletools.genops(io.BytesIO(data)), 1):
            known += op.name in ("MARK", "STOP", "TUPLE", "LIST", "DICT", "SETITEM", "BUILD", "REDUCE")
            if n >= 3 and known >= 2:
                return True
            if n > 20:
                return False
    except Exception:
        return False
    return False


#: First bytes of pickles without a protocol, and opcodes that put a string on the stack.
PICKLE_STARTS = [bytes([c]) for c in b"(]}cldtpqgILFSUNVM"]
STRINGS = {"STRING", "BINSTRING", "SHORT_BINSTRING", "UNICODE", "BINUNICODE", "SHORT_BINUNICODE", "BINUNICODE8"}


def reference(arg: str) -> tuple[str, str] | None:
    """(module, name) of "module name" or "module.name"."""
    module, _, name = arg.partition(" ") if " " in arg else arg.rpartition(".")
    return (module, name) if module and name else None


class Symbols:
    """A pickle's stack and memo with names in place of values: what each opcode refers to and what it calls.

    How many items an opcode takes and leaves comes from the library's own
    table of stack effects.
    """

    MARK, UNKNOWN = object(), object()
    #: opcodes that change an item below the taken ones and leave it
    IN_PLACE = {"APPEND", "APPENDS", "SETITEM", "SETITEMS", "ADDITEMS", "BUILD"}

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.stack, self.memo, self.next = [], {}, 0

    def _pop(self):
        return self.stack.pop() if self.stack else self.UNKNOWN

    def _to_mark(self) -> list:
        taken = []
        while self.stack and (item := self.stack.pop()) is not self.MARK:
            taken.append(item)
        return taken[::-1]

    def step(self, op, arg) -> tuple[tuple[str, str] | None, tuple[str, str] | None]:
        """What a global opcode refers to, and what a calling opcode calls; None where that can't be told."""
        name, stack = op.name, self.stack
        ref = called = None
        as_ref = lambda x: x if isinstance(x, tuple) else None
        if name == "STOP":
            self.clear()
        elif name in STRINGS and isinstance(arg, str):
            stack.append(arg)
        elif name == "GLOBAL":
            ref = reference(arg)
            stack.append(ref or self.UNKNOWN)
        elif name in ("EXT1", "EXT2", "EXT4"):
            ref = (EXTENSION, f"ext_{arg}")
            stack.append(ref)
        elif name == "STACK_GLOBAL":
            second, first = self._pop(), self._pop()
            ref = (first, second) if isinstance(first, str) and isinstance(second, str) else None
            stack.append(ref or self.UNKNOWN)
        elif name == "INST":
            self._to_mark()
            ref = called = reference(arg)
            stack.append(self.UNKNOWN)
        elif name in ("PUT", "BINPUT", "LONG_BINPUT"):
            self.memo[arg] = stack[-1] if stack else self.UNKNOWN
            self.next = max(self.next, arg + 1 if isinstance(arg, int) else 0)
        elif name == "MEMOIZE":
            self.memo[self.next] = stack[-1] if stack else self.UNKNOWN
            self.next += 1
        elif name in ("GET", "BINGET", "LONG_BINGET"):
            stack.append(self.memo.get(arg, self.UNKNOWN))
        elif name == "MARK":
            stack.append(self.MARK)
        elif name == "DUP":
            stack.append(stack[-1] if stack else self.UNKNOWN)
        elif name == "OBJ":
            taken = self._to_mark()
            called = as_ref(taken[0]) if taken else None
            stack.append(self.UNKNOWN)
        elif name in ("REDUCE", "NEWOBJ", "NEWOBJ_EX"):
            for _ in range(len(op.stack_before) - 1):
                self._pop()
            called = as_ref(self._pop())
            stack.append(self.UNKNOWN)
        else:
            before = [x.name for x in op.stack_before]
            if "mark" in before:
                self._to_mark()
                before = before[: before.index("mark")]
            kept = 1 if name in self.IN_PLACE else 0
            for _ in range(len(before) - kept):
                self._pop()
            stack += [self.UNKNOWN] * (len(op.stack_after) - kept)
        return ref, called


EXTENSION = "copyreg._extension_registry"


def opcodes(files: DataFrame) -> DataFrame:
    """path, idx, name, arg, pos, module, function, called_module, called_function, nested, error: the opcodes of all pickle streams of a file, read and never run.

    module and function: what a global opcode refers to; called_*: what a calling
    opcode calls, followed through stack and memo. nested: whether the argument
    is a pickle itself. arg is the whole argument.
    """

    def parse(data: bytes):
        stream, n, symbols = io.BytesIO(data), 0, Symbols()
        while stream.tell() < len(data) and n < MAX_OPCODES:
            start = stream.tell()
            try:
                for op, arg, pos in pickletools.genops(stream):
                    ref, called = symbols.step(op, arg)
                    raw = arg if isinstance(arg, (bytes, bytearray)) else arg.encode("utf-8", "replace") if isinstance(arg, str) and op.name in STRINGS else b""
                    text = None if arg is None else arg.decode("latin-1") if isinstance(arg, (bytes, bytearray)) else str(arg)
                    yield {
                        "idx": n,
                        "name": op.name,
                        "arg": None if text is None else text.encode("utf-8", "replace").decode(),
                        "pos": pos,
                        **dict(zip(("module", "function"), ref or (None, None), strict=True)),
                        **dict(zip(("called_module", "called_function"), called or (None, None), strict=True)),
                        "nested": looks_like_pickle(bytes(raw[:1024])) or _decoded_pickle(text if op.name in STRINGS else None),
                    }
                    n += 1
                    if n >= MAX_OPCODES:
                        yield {"idx": n, "error": "too many opcodes"}
                        return
            except Exception as e:
                yield {"idx": n, "pos": start, "error": f"{type(e).__name__}: {e}"[:200]}
                return

    return _rows(files, parse, "idx bigint, name string, arg string, pos bigint, module string, function string, called_module string, called_function string, nested boolean, error string")


def _decoded_pickle(text: str | None) -> bool:
    """Whether base64 or hex digits decode to a pickle."""
    if not text or len(text) < 16:
        return False
    for decode in (lambda: base64.b64decode(text, validate=True), lambda: bytes.fromhex(text)):
        try:
            if looks_like_pickle(decode()[:1024]):
                return True
        except ValueError:
            continue
    return False


def _inside(name: str) -> bool:
    """Whether a member's name stays inside: neither absolute nor climbing out at any point."""
    depth, path = 0, name.replace("\\", "/")
    if path.startswith("/") or path[1:2] == ":":
        return False
    for part in path.split("/"):
        depth += 0 if part in ("", ".") else -1 if part == ".." else 1
        if depth < 0:
            return False
    return True


def _codec(data: bytes) -> str | None:
    """The compression that the first bytes tell."""
    if data[:2] == b"\x1f\x8b":
        return "gzip"
    if data[:3] == b"BZh":
        return "bzip2"
    if data[:6] == b"\xfd7zXZ\x00":
        return "xz"
    if data[:4] == b"\x04\x22\x4d\x18":
        return "lz4"
    if len(data) >= 2 and data[0] & 15 == 8 and data[0] >> 4 <= 7 and (data[0] << 8 | data[1]) % 31 == 0:
        return "zlib"
    return None


def _expanded(data: bytes) -> tuple[bytes | None, str | None]:
    """The content of a compressed file and what is wrong with it; never more than the limits."""
    codec = _codec(data)
    limit = min(MAX_MEMBER_BYTES, 100 * max(len(data), 1 << 16))
    if codec == "lz4":
        return None, "lz4 can't be read here"
    if codec == "zlib":
        out = zlib.decompressobj().decompress(data, limit + 1)
    else:
        opened = {"gzip": gzip.GzipFile, "bzip2": bz2.BZ2File, "xz": lzma.LZMAFile}[codec]
        with (opened(fileobj=io.BytesIO(data)) if codec == "gzip" else opened(io.BytesIO(data))) as f:
            out = f.read(limit + 1)
    return (None, "compression ratio or size") if len(out) > limit else (out, None)


def _members(data: bytes):
    """(name, bytes or None, error) of one archive or compressed file."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for n, info in enumerate(z.infolist()):
                if n >= MAX_ENTRIES:
                    yield None, None, "too many entries"
                    return
                if info.external_attr >> 28 == 0o12:
                    yield info.filename, None, f"link to {z.read(info)[:200].decode('utf-8', 'replace')}"
                elif not _inside(info.filename):
                    yield info.filename, None, "path leaves the archive"
                elif not info.is_dir():
                    big = info.file_size > MAX_MEMBER_BYTES or info.file_size > 100 * max(1, info.compress_size)
                    yield info.filename, None if big else z.read(info), "compression ratio or size" if big else None
    elif data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for n, info in enumerate(t):
                if n >= MAX_ENTRIES:
                    yield None, None, "too many entries"
                    return
                if info.issym() or info.islnk():
                    yield info.name, None, f"link to {info.linkname}"
                elif not _inside(info.name):
                    yield info.name, None, "path leaves the archive"
                elif info.isfile():
                    big = info.size > MAX_MEMBER_BYTES
                    yield info.name, None if big else t.extractfile(info).read(), "size" if big else None
    elif _codec(data):
        yield "content", *_expanded(data)


def _nested(data: bytes | None) -> bool:
    return bool(data) and (data[:2] == b"PK" or data[257:262] == b"ustar" or _codec(data) in ("gzip", "bzip2", "xz"))


def archive_members(files: DataFrame) -> DataFrame:
    """path, member, depth, content, error: members of ZIP, TAR and compressed files, archives within them included down to MAX_DEPTH.

    A member that is too large, packed too well, a link, or that would leave the
    archive has no content and says why; the members of one file may hold
    MAX_TOTAL_BYTES together, and what is beyond says so too.
    """

    def parse(data: bytes):
        left = MAX_TOTAL_BYTES

        def walk(data: bytes, prefix: str, depth: int):
            nonlocal left
            for name, content, error in _members(data):
                member = f"{prefix}{name}"
                left -= len(content or b"")
                if left < 0:
                    content, error = None, "members are too large together"
                yield {"member": member, "depth": depth, "content": content, "error": error}
                if _nested(content):
                    if depth >= MAX_DEPTH:
                        yield {"member": member, "depth": depth, "error": "too deep"}
                    else:
                        yield from walk(content, f"{member}:", depth + 1)

        yield from walk(data, "", 1)

    return _rows(files, parse, "member string, depth int, content binary, error string")


def numpy_headers(files: DataFrame) -> DataFrame:
    """path, dtype, shape, fortran_order, is_object, expected, error: headers of NumPy files; an object array is a pickle."""

    def parse(data: bytes):
        if data[:6] != b"\x93NUMPY":
            raise ValueError("no NumPy file")
        wide = data[6] >= 2
        (size,) = struct.unpack_from("<I" if wide else "<H", data, 8)
        at = 12 if wide else 10
        head = ast.literal_eval(data[at : at + size].decode("latin-1"))
        kind, shape = str(head["descr"]), [int(x) for x in head["shape"]]
        width = re.search(r"(\d+)$", kind)
        expected = math.prod(shape) * int(width[1]) * (4 if "U" in kind else 1) if width else None
        wrong = expected is not None and expected != len(data) - at - size
        yield {"dtype": kind, "shape": shape, "fortran_order": bool(head["fortran_order"]), "is_object": "O" in kind, "expected": expected, "error": "size doesn't fit the shape" if wrong else None}

    return _rows(files, parse, "dtype string, shape array<bigint>, fortran_order boolean, is_object boolean, expected bigint, error string")


def wire_fields(data: bytes):
    """(number, kind, value) of the fields of a protocol buffer message: kind 0 a number, 1 and 5 raw bytes, 2 bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7
            if shift > 63:
                raise ValueError("number is too long")

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, 0, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else -1)
        if size < 0 or at + size > len(data):
            raise ValueError("field beyond the end")
        at += size
        yield key >> 3, kind, data[at - size : at]


def _parts(data: bytes, number: int) -> list[bytes]:
    return [v for n, kind, v in wire_fields(data) if n == number and kind == 2]


def _text(data: bytes, number: int) -> str:
    return next((v.decode("utf-8", "replace") for v in _parts(data, number)), "")


def onnx_nodes(files: DataFrame) -> DataFrame:
    """path, idx, name, op, domain, location, error: nodes of ONNX graphs, and where tensors outside of the file stand (op "external_data")."""

    def parse(data: bytes):
        n = 0
        for graph in _parts(data, 7):
            for node in _parts(graph, 1):
                yield {"idx": n, "name": _text(node, 3), "op": _text(node, 4), "domain": _text(node, 7)}
                n += 1
            for tensor in _parts(graph, 5):
                entries = {_text(e, 1): _text(e, 2) for e in _parts(tensor, 13)}
                if entries:
                    yield {"idx": n, "name": _text(tensor, 8), "op": "external_data", "location": entries.get("location")}
                    n += 1

    return _rows(files, parse, "idx bigint, name string, op string, domain string, location string, error string")


def tensorflow_nodes(files: DataFrame) -> DataFrame:
    """path, idx, name, op, error: nodes of saved models and their functions."""

    def parse(data: bytes):
        n = 0
        for meta in _parts(data, 2):
            for graph in _parts(meta, 2):
                functions = [f for library in _parts(graph, 2) for f in _parts(library, 1)]
                for node in [*_parts(graph, 1), *(x for f in functions for x in _parts(f, 3))]:
                    yield {"idx": n, "name": _text(node, 1), "op": _text(node, 2)}
                    n += 1

    return _rows(files, parse, "idx bigint, name string, op string, error string")


def oci_layers(files: DataFrame) -> DataFrame:
    """path, layer, error: the layer archives that container manifests name."""

    def parse(data: bytes):
        todo = [json.loads(data)]
        while todo:
            value = todo.pop()
            if isinstance(value, dict):
                todo += list(value.values())[::-1]
            elif isinstance(value, list):
                todo += value[::-1]
            elif isinstance(value, str) and value.endswith((".tar", ".tar.gz", ".tgz")):
                yield {"layer": value}

    return _rows(files, parse, "layer string, error string")


def dvc_outputs(files: DataFrame) -> DataFrame:
    """path, target, is_inside: what the outs of DVC files stand for, beside them; targets that climb out are told."""
    text = F.decode("content", "ISO-8859-1")
    listed = F.regexp_extract_all(F.regexp_extract(text, r"(?s)(?:^|\n)outs:(.*?)(?:\n[^\s-]|$)", 1), F.lit(r"(?m)^\s*-?\s*path:\s*[\"']?([^\"'\n\r]+?)[\"']?\s*$"), F.lit(1))
    base = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    rows = files.select("path", F.explode(listed).alias("out"), base.alias("base"))
    from ..functions.classify import safe_member

    return rows.select("path", F.concat("base", "out").alias("target"), safe_member(F.col("out")).alias("is_inside"))


WINDOW_BYTES = 500 << 20
OVERLAP_BYTES = 1 << 20


def file_windows(spark: SparkSession, path: str, window: int = WINDOW_BYTES, overlap: int = OVERLAP_BYTES, piece: int = 64 << 20) -> DataFrame:
    """path, start, content: overlapping windows of files of any size, read by ranges, so a file needs not fit in a row or a task.

    A window is given in pieces of at most ``piece`` bytes with the same overlap.
    Matches are told apart by their place in the file (start + place in content),
    so what lies in an overlap is found once by a distinct on that.
    """
    step = max(1, min(window, piece) - overlap)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    last = F.greatest(F.col("length") - overlap - 1, F.lit(0))
    ranges = listed.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long"))).alias("start"))
    size = min(window, piece)

    def read(batches):
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = pa_fs.FileSystem.from_uri(name if "://" in name else name.replace("file:", "file://", 1))
                with store.open_input_file(place) as f:
                    f.seek(start)
                    data = f.read(size)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([start], pa.int64()), pa.array([data], pa.binary())], names=["path", "start", "content"])

    return ranges.select("path", "start").repartition("path", "start").mapInArrow(read, "path string, start long, content binary")


def window_matches(windows: DataFrame, patterns: list[bytes]) -> DataFrame:
    """path, pattern, position: where the byte patterns stand in files, each place once."""

    def search(batches):
        for batch in batches:
            for name, start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hits = [(p, start + m.start()) for p in patterns for m in re.finditer(b"(?=" + re.escape(p) + b")", data)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(hits)), pa.array([p.decode("latin-1") for p, _ in hits]), pa.array([x for _, x in hits], pa.int64())], names=["path", "pattern", "position"])

    return windows.mapInArrow(search, "path string, pattern string, position long").distinct()


def printable_strings(files: DataFrame, least: int = 4, most: int = 512) -> DataFrame:
    """path, idx, string: runs of printable ASCII, in order."""
    found = F.regexp_extract_all(F.decode("content", "ISO-8859-1"), F.lit(f"[ -~]{{{least},{most}}}"), F.lit(0))
    return files.select("path", F.posexplode(found).alias("idx", "string"))


def lfs_pointers(files: DataFrame) -> DataFrame:
    """path, oid, size of files that are only Git LFS pointers."""
    text = F.decode(F.substring("content", 1, 200), "ISO-8859-1")
    rows = files.where(F.startswith(text, F.lit("version https://git-lfs")))
    return rows.select("path", F.regexp_extract(text, r"oid sha256:([0-9a-f]{64})", 1).alias("oid"), F.regexp_extract(text, r"size (\d+)", 1).try_cast("long").alias("size"))


def partial(files: DataFrame, most: int) -> DataFrame:
    """``files`` with at most ``most`` bytes of content, bytes_analyzed and analysis_complete: what a look at the beginning has seen."""
    whole = F.col("length") <= most
    return files.withColumns({"content": F.substring("content", 1, most), "bytes_analyzed": F.least(F.col("length"), F.lit(most).cast("long")), "analysis_complete": whole})


def search(files: DataFrame, patterns: list[str], text: str = "content") -> DataFrame:
    """path, pattern: byte patterns (Latin-1) that stand in files: what is left for files without a parser."""
    data = F.decode(text, "ISO-8859-1")
    return files.select("path", F.explode(F.array_compact(F.array(*[F.when(F.contains(data, F.lit(p)), F.lit(p)) for p in patterns]))).alias("pattern"))
