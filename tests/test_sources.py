"""Parsers of files that are built here, reports and streams."""

import io
import json
import pickle
import struct
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sluicework.functions import detect
from sluicework.functions.rules import BUILT_IN, built_in, match_rules, read_catalogue
from sluicework.sources import binary, reports
from sluicework.streaming import files as stream


def safetensors_bytes(tensors):
    head = json.dumps(tensors).encode()
    end = max((t["data_offsets"][1] for k, t in tensors.items() if k != "__metadata__"), default=0)
    return struct.pack("<Q", len(head)) + head + bytes(end)


def gguf_bytes():
    text = lambda s: struct.pack("<Q", len(s)) + s.encode()
    pairs = text("name") + struct.pack("<I", 8) + text("tiny") + text("layers") + struct.pack("<II", 4, 7) + text("sizes") + struct.pack("<IIQ", 9, 4, 3) + struct.pack("<III", 1, 2, 3)
    return b"GGUF" + struct.pack("<IQQ", 3, 5, 3) + pairs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    good = {"__metadata__": {"a": "b"}, "w": {"dtype": "F32", "shape": [2, 3], "data_offsets": [0, 24]}, "v": {"dtype": "I64", "shape": [2], "data_offsets": [24, 40]}}
    (d / "a.safetensors").write_bytes(safetensors_bytes(good))
    (d / "bad.safetensors").write_bytes(struct.pack("<Q", 10**9) + b"{}")
    (d / "m.gguf").write_bytes(gguf_bytes())
    (d / "cut.gguf").write_bytes(gguf_bytes()[:60])
    (d / "p.pkl").write_bytes(pickle.dumps({"a": [1, 2]}) + pickle.dumps("second"))
    (d / "junk.pkl").write_bytes(b"\x80\x04\xff\xff")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("in.zip", inner.getvalue())
        z.writestr("bomb", b"0" * 3_000_000)
    (d / "z.zip").write_bytes(outer.getvalue())
    with tarfile.open(d / "t.tar", "w") as t:
        info = tarfile.TarInfo("x/y.txt")
        info.size = 2
        t.addfile(info, io.BytesIO(b"hi"))
        link = tarfile.TarInfo("l")
        link.type, link.linkname = tarfile.SYMTYPE, "/etc/passwd"
        t.addfile(link)
    (d / "ptr.bin").write_text("version https://git-lfs.github.com/spec/v1\noid sha256:" + "a" * 64 + "\nsize 123\n")
    (d / "empty.bin").write_bytes(b"")
    return str(d)


def named(df, *columns):
    return sorted(tuple(r) for r in df.select(F.element_at(F.split("path", "/"), -1), *columns).collect())


def test_safetensors(spark, folder):
    rows = binary.safetensors(binary.read_files(spark, folder, "*.safetensors")).collect()
    good = {r.name: (r.dtype, r.shape, r.begin, r.end, r.error) for r in rows if r.path.endswith("/a.safetensors")}
    assert good == {"w": ("F32", [2, 3], 0, 24, None), "v": ("I64", [2], 24, 40, None)}
    assert [r.error is not None for r in rows if "bad" in r.path] == [True]


def test_gguf(spark, folder):
    rows = binary.gguf(binary.read_files(spark, folder, "*.gguf")).collect()
    assert {r.key: r.value for r in rows if r.path.endswith("/m.gguf")} == {"n_tensors": "5", "name": "tiny", "layers": "7", "sizes": "[1, 2, 3]"}
    assert any(r.error for r in rows if "cut" in r.path)


def test_opcodes(spark, folder):
    rows = binary.opcodes(binary.read_files(spark, folder, "*.pkl"))
    whole = rows.where("path like '%/p.pkl'").orderBy("idx").collect()
    assert [r.idx for r in whole] == list(range(len(whole))) and sum(r.name == "STOP" for r in whole) == 2
    assert rows.where("path like '%junk%' and error is not null").count() == 1


def test_members(spark, folder):
    zipped = named(binary.archive_members(binary.read_files(spark, folder, "*.zip")), "member", "depth", "error")
    assert ("z.zip", "in.zip", 1, None) in zipped and ("z.zip", "in.zip:deep.txt", 2, None) in zipped and ("z.zip", "bomb", 1, "compression ratio or size") in zipped
    tarred = named(binary.archive_members(binary.read_files(spark, folder, "*.tar")), "member", "error")
    assert tarred == [("t.tar", "l", "link to /etc/passwd"), ("t.tar", "x/y.txt", None)]


def test_strings_and_pointers(spark, folder):
    files = binary.read_files(spark, folder, "*.bin")
    assert named(binary.lfs_pointers(files), "oid", "size") == [("ptr.bin", "a" * 64, 123)]
    assert named(binary.printable_strings(files), "idx")[0] == ("ptr.bin", 0)


def test_stream_finds_what_a_batch_finds(spark, folder, tmp_path):
    query = stream.scan_stream(binary.read_file_stream(spark, folder, 3), binary.printable_strings, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out/findings").drop("batch")
    batch = binary.printable_strings(binary.read_files(spark, folder))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, batch.collect()))
    assert spark.read.parquet(f"{tmp_path}/out/files").count() == binary.read_files(spark, folder).count()


def test_reports(spark, tmp_path):
    issues = spark.createDataFrame([(1, "eval: m", "critical", "/a b/c.pkl", "x"), (2, "n", "debug", None, None), (3, "eval: m", "info", "/x", "x")], "seq long, message string, severity string, location string, type string")
    assert [(r.seq, r.rule_id, r.name, r.level) for r in reports.sarif_rules(issues).orderBy("seq").collect()] == [(1, "MAX", "X", "error"), (2, "MA-N", "n", "none")]
    assert {r.seq: (r.level, r.uri, r.rank) for r in reports.sarif_results(issues).collect()} == {1: ("error", "/a%20b/c.pkl", 90.0), 2: ("none", None, 10.0), 3: ("note", "/x", 30.0)}
    reports.write_json(issues, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_rules(spark, tmp_path):
    built_in(spark).write.json(f"{tmp_path}/rules")
    rules = read_catalogue(spark, f"{tmp_path}/rules")
    assert rules.count() == len(BUILT_IN)
    rows = spark.createDataFrame([("IMPORT  os now eval(",), ("nothing",), (None,), ("eval(x)",)], "message string")
    assert {r.message: r.rule_code for r in match_rules(rows, rules).collect()} == {"IMPORT  os now eval(": "S101", "nothing": None, None: None, "eval(x)": "S104"}


def test_entropy(spark):
    rows = spark.createDataFrame([("",), ("aaaa",), ("abcd",), ("aabb",)], "t string")
    assert {r.t: r.e for r in rows.select("t", detect.entropy(F.col("t")).alias("e")).collect()} == {"": 0.0, "aaaa": 0.0, "abcd": 2.0, "aabb": 1.0}


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a"), (700, "b")], "s int, k string").select(F.timestamp_seconds("s").alias("ts"), "k").write.parquet(f"{tmp_path}/e")
    events = spark.readStream.schema("ts timestamp, k string").parquet(f"{tmp_path}/e")
    query = stream.windowed_counts(events, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.k, r.n) for r in spark.table("windowed").collect()) == [("a", 2), ("b", 1)]


def test_calls_are_followed_through_stack_and_memo(spark, tmp_path):
    class Evil:
        def __reduce__(self):
            return (print, ("x",))

    for protocol in range(6):
        (tmp_path / f"{protocol}.pkl").write_bytes(pickle.dumps([Evil(), Evil(), {"a": (1, 2)}], protocol))
    rows = binary.opcodes(binary.read_files(spark, str(tmp_path))).where("called_module is not null").collect()
    called = {}
    for r in rows:
        called.setdefault(r.path[-5], []).append((r.name, r.called_module in ("builtins", "__builtin__"), r.called_function))
    assert called == {str(p): [("REDUCE", True, "print")] * 2 for p in range(6)}


def test_compressed_and_unsafe_members(spark, tmp_path):
    import bz2
    import gzip
    import lzma
    import zlib

    inner = io.BytesIO()
    with tarfile.open(fileobj=inner, mode="w") as t:
        for name in ("ok.txt", "../up.txt"):
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
    (tmp_path / "a.tar.gz").write_bytes(gzip.compress(inner.getvalue()))
    (tmp_path / "b.bz2").write_bytes(bz2.compress(b"text"))
    (tmp_path / "c.xz").write_bytes(lzma.compress(b"text"))
    (tmp_path / "d.zlib").write_bytes(zlib.compress(b"text"))
    (tmp_path / "e.gz").write_bytes(gzip.compress(bytes(50_000_000)))
    (tmp_path / "f.gz").write_bytes(b"\x1f\x8bbroken")
    got = {(r.path.rsplit("/", 1)[1], r.member): (None if r.content is None else bytes(r.content), r.error) for r in binary.archive_members(binary.read_files(spark, str(tmp_path))).collect()}
    assert got["a.tar.gz", "content:ok.txt"] == (b"hi", None) and got["a.tar.gz", "content:../up.txt"] == (None, "path leaves the archive")
    assert all(got[f, "content"] == (b"text", None) for f in ("b.bz2", "c.xz", "d.zlib"))
    assert got["e.gz", "content"] == (None, "compression ratio or size") and got["f.gz", None][1]


def test_numpy_headers(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "a.npy", np.zeros((2, 3), "f4"))
    np.save(tmp_path / "o.npy", np.array([{}, 1], object), allow_pickle=True)
    (tmp_path / "cut.npy").write_bytes((tmp_path / "a.npy").read_bytes()[:-4])
    got = {r.path.rsplit("/", 1)[1]: r for r in binary.numpy_headers(binary.read_files(spark, str(tmp_path))).collect()}
    assert (got["a.npy"].dtype, got["a.npy"].shape, got["a.npy"].expected, got["a.npy"].error) == ("<f4", [2, 3], 24, None)
    assert got["o.npy"].is_object and got["cut.npy"].error


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3]) + bytes([value])
    data = value if isinstance(value, bytes) else value.encode()
    return bytes([number << 3 | 2, len(data)]) + data


def test_graphs(spark, tmp_path):
    entry = field(1, "location") + field(2, "../../etc/x")
    node = field(3, "n1") + field(4, "PythonOp") + field(7, "com.x")
    (tmp_path / "m.onnx").write_bytes(field(1, 8) + field(7, field(1, node) + field(5, field(8, "w") + field(13, entry))))
    (tmp_path / "saved_model.pb").write_bytes(field(1, 1) + field(2, field(2, field(1, field(1, "a") + field(2, "PyFunc")) + field(2, field(1, field(3, field(1, "b") + field(2, "ReadFile")))))))
    (tmp_path / "cut.onnx").write_bytes(b"\x3a\xff")
    files = binary.read_files(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.op): (r.name, r.domain, r.location) for r in binary.onnx_nodes(files.where("path like '%m.onnx'")).collect()}
    assert got == {("m.onnx", "PythonOp"): ("n1", "com.x", None), ("m.onnx", "external_data"): ("w", None, "../../etc/x")}
    assert [(r.name, r.op) for r in binary.tensorflow_nodes(files.where("path like '%.pb'")).collect()] == [("a", "PyFunc"), ("b", "ReadFile")]
    assert binary.onnx_nodes(files.where("path like '%cut%'")).first().error


def test_manifests(spark, tmp_path):
    (tmp_path / "m.manifest").write_text(json.dumps({"layers": [{"path": "a.tar.gz"}, "b.tar", "c.txt"]}))
    (tmp_path / "x.dvc").write_text("outs:\n- md5: abc\n  path: data/model.pkl\n- path: '../../up'\nmeta: 1\n")
    files = binary.read_files(spark, str(tmp_path))
    assert sorted(r.layer for r in binary.oci_layers(files.where("path like '%manifest'")).collect()) == ["a.tar.gz", "b.tar"]
    got = {r.target.rsplit(str(tmp_path), 1)[1]: r.is_inside for r in binary.dvc_outputs(files.where("path like '%.dvc'")).collect()}
    assert got == {"/data/model.pkl": True, "/../../up": False}


def test_windows_find_each_place_once(spark, tmp_path):
    data = bytearray(10_000)
    for at in (0, 995, 1000, 5555, 9996):
        data[at : at + 4] = b"EVIL"
    (tmp_path / "big.bin").write_bytes(bytes(data))
    windows = binary.file_windows(spark, str(tmp_path), window=1000, overlap=10)
    assert windows.count() > 9 and windows.selectExpr("max(length(content))").first()[0] == 1000
    assert sorted(r.position for r in binary.window_matches(windows, [b"EVIL"]).collect()) == [0, 995, 1000, 5555, 9996]


def test_documents_are_json(spark, tmp_path):
    issues = spark.createDataFrame([(7, "import os, \"x\"", "critical", "/a b/c.pkl", None, "/a b/c.pkl"), (9, "secret: y", "info", None, "secret kind", "/z")], "seq long, message string, severity string, location string, type string, asset string")
    assets = spark.createDataFrame([("/a b/c.pkl", "pickle", 5, "f" * 64), ("/z", "zip", 6, "e" * 64)], "path string, type string, length long, sha256 string")
    summary = {"files_scanned": 2, "bytes_scanned": 11, "exit_code": 1, "has_errors": False, "total_checks": 3}

    def document(lines, name):
        reports.write_lines(lines, f"{tmp_path}/{name}")
        return json.loads("\n".join(r.value for r in spark.read.text(f"{tmp_path}/{name}").collect()))

    sarif = document(reports.sarif_lines(issues, assets, summary), "sarif")
    (run,) = sarif["runs"]
    assert sarif["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["MA-IMPORT-OS-X", "MASECRET-KIND"]
    assert [(r["ruleId"], r["level"], r["kind"]) for r in run["results"]] == [("MA-IMPORT-OS-X", "error", "fail"), ("MASECRET-KIND", "note", "informational")]
    assert run["results"][0]["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "/a%20b/c.pkl" and len(run["artifacts"]) == 2 and run["properties"] == {"total_checks": 3}
    files = assets.withColumnsRenamed({"length": "size"}).withColumn("licenses", F.array(F.lit("MIT"), F.lit("GPL-3.0"), F.lit("MIT")))
    bom = document(reports.sbom_lines(files, issues), "bom")
    assert bom["specVersion"] == "1.6" and [(c["type"], c["name"]) for c in bom["components"]] == [("machine-learning-model", "c.pkl"), ("file", "z")]
    assert bom["components"][0]["licenses"] == [{"expression": "MIT OR GPL-3.0"}] and {"name": "risk_score", "value": "5"} in bom["components"][0]["properties"]
    empty = document(reports.sarif_lines(issues.where("false"), assets.where("false"), {}), "empty")
    assert empty["runs"][0]["results"] == []


def test_text_report(spark):
    checks = spark.createDataFrame([(i, f"c{i % 7}", "failed") for i in range(20)], "seq long, name string, status string")
    issues = spark.createDataFrame([(1, "info", "/a", "x"), (2, "critical", "/b", "y"), (3, "critical", "/a", "z")], "seq long, severity string, location string, message string")
    lines = [r.line for r in reports.report_lines(checks, issues, {"files_scanned": 4}).orderBy("section", "place").collect()]
    assert lines == ["Files: 4, bytes: 0", "Failed checks: c0 (3), c1 (3), c2 (3), c3 (3), c4 (3) and 2 more", "critical: 2, warning: 0, info: 1, debug: 0", "[CRITICAL] /b y", "[CRITICAL] /a z", "[INFO] /a x"]


def test_cache_keeps_the_newest(spark, tmp_path):
    from sluicework.operators.groups import write_cache

    make = lambda rows: spark.createDataFrame(rows, "h string, scanned_at double, result string")
    write_cache(make([("aa1", 1.0, "old"), ("bb1", 1.0, "b")]), f"{tmp_path}/cache")
    write_cache(make([("aa1", 2.0, "new"), ("aa2", 2.0, "c")]), f"{tmp_path}/cache")
    assert {r.h: r.result for r in spark.read.parquet(f"{tmp_path}/cache").collect()} == {"aa1": "new", "aa2": "c", "bb1": "b"}


def test_a_directory_is_scanned(spark, tmp_path):
    from sluicework.operators.scan import Options, scan

    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    (src / "a.pkl").write_bytes(b"cos\nsystem\n(S'id'\ntR.")
    (src / "sub" / "copy.pkl").write_bytes(b"cos\nsystem\n(S'id'\ntR.")
    (src / "big.bin").write_bytes(bytes(5000))
    (src / "model_card").write_text("plain words")
    (src / "x.py").write_text("import os")
    plug = lambda units: units.where("path like '%model_card'").selectExpr("path", "0L as place", "'Mine' as name", "'failed' as status", "cast(null as string) as severity", "'told by a plug-in' as message", "path as location", "cast(null as string) as rule_code")
    suppress = spark.createDataFrame([("S201", "*a.pkl*")], "code string, glob string")
    found = scan(binary.read_files(spark, str(src)), f"file://{tmp_path}/out", Options(max_file_size=4000, detectors={"mine": plug}, suppressions=suppress))
    got = sorted((r.location.split("/in/")[1].split(" ")[0], r.name, r.severity, r.rule_code) for r in found.issues.collect())
    assert got == [("a.pkl", "Global Module Reference Check", "critical", "S101"), ("big.bin", "File Size Limit Check", "info", "S904"), ("model_card", "Mine", "warning", None)]
    row = found.summary.first()
    assert (row.files_scanned, row.duplicates, row.has_errors, row.has_critical, row.exit_code) == (4, 1, False, True, 1)


def test_the_end_of_a_stream(spark, folder, tmp_path):
    def broken(rows):
        raise RuntimeError("scanner is broken")

    for name, scanner in (("good", binary.printable_strings), ("bad", broken)):
        stream.scan_stream(binary.read_file_stream(spark, folder, 4), scanner, f"{tmp_path}/{name}", f"{tmp_path}/check-{name}").awaitTermination(120)
    good, bad = (stream.finish(spark, f"{tmp_path}/{n}").first() for n in ("good", "bad"))
    from sluicework.operators.groups import aggregate_hash

    files = binary.read_files(spark, folder).select(F.sha2("content", 256).alias("h")).distinct()
    assert good.aggregate_hash == bad.aggregate_hash == aggregate_hash(files, "h").first().aggregate_hash
    assert (good.has_errors, bad.has_errors, good.analysis_complete) == (False, True, True)
    stream.scan_stream(binary.read_file_stream(spark, folder, 100), binary.printable_strings, f"{tmp_path}/late", f"{tmp_path}/check-late", budget=-1.0).awaitTermination(120)
    assert not stream.finish(spark, f"{tmp_path}/late").first().analysis_complete
