"""Detectors, verdicts and classification on cases whose answers follow from the rules, typed by hand."""

import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from sluicework.functions import classify as K
from sluicework.functions import code
from sluicework.functions import config as C
from sluicework.functions import detect as D
from sluicework.functions import verdicts as V
from sluicework.functions.rules import built_in, match_rules
from sluicework.operators import checks as checks_
from sluicework.operators import weights as W


def each(spark, values, expression, schema="t string"):
    """The expression's value for each of the values, in their order."""
    rows = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], f"i int, {schema}")
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


def findings(spark, text, array):
    rows = spark.createDataFrame([(text, "notes.txt")], "t string, p string")
    return [tuple(r) for r in D.explode_findings(rows, array).collect()]


def values(spark, text, array):
    return sorted(r[3] for r in findings(spark, text, array))




@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("8.8.8.8", ["8.8.8.8"]),
        ("8.8.8.8 version", []),
        ("release 8.8.8.8", []),
        ("8.8.8.8 and more than twenty signs before the version", ["8.8.8.8"]),
        ('a "10.2.3.4" b', []),
        ('a "110.2.3.4" b', ["110.2.3.4"]),
        ("[1.0.2.0, 2.5]", []),
        ("[1.2.3.4]", ["1.2.3.4"]),
        ("bias {9.9.9.9}", []),
        ("256.1.1.1 and 1.2.3.4.5", ["1.2.3.4"]),
        ("192.168.1.01", []),
    ],
)
def test_ipv4_context(spark, text, found):
    assert values(spark, text, D.ipv4_findings(F.col("t"))) == found


def test_ip_confidence(spark):
    got = {r[3]: r[2] for r in findings(spark, "10.0.0.1 8.8.8.8 100.64.0.1 192.0.0.9 192.0.0.8 172.32.0.1 240.1.1.1", D.ipv4_findings(F.col("t")))}
    assert got == {"10.0.0.1": 0.3, "8.8.8.8": 0.7, "100.64.0.1": 0.4, "192.0.0.9": 0.7, "192.0.0.8": 0.3, "172.32.0.1": 0.7, "240.1.1.1": 0.3}
    assert values(spark, "x fe80:0:0:0:0:0:0:1 y", D.ipv6_findings(F.col("t"))) == ["fe80:0:0:0:0:0:0:1"]


def test_libraries_need_a_use(spark):
    assert values(spark, "many requests to redistribute the socket", D.library_findings(F.col("t"))) == []
    assert values(spark, "import socket; requests.request(x); from redis import y", D.library_findings(F.col("t"))) == ["redis", "requests", "socket"]


def test_urls_and_domains(spark):
    got = {r[3]: (r[1], r[2]) for r in findings(spark, "http://a.b/eval ftps://c.d http://e.f:1337/ https://g.h/[1]", D.url_findings(F.col("t")))}
    assert got == {"http://a.b/eval": ("HIGH", 0.9), "ftps://c.d": ("MEDIUM", 0.7), "http://e.f:1337/": ("HIGH", 0.8), "https://g.h/[1]": ("MEDIUM", 0.5)}
    text = "evil.example.com model.pt layer1.weight.io numpy.org a.to abc.to www.example.zz"
    assert values(spark, text, D.domain_findings(F.col("t"), F.lit("x.txt"))) == ["abc.to", "evil.example.com"]
    assert values(spark, text + ' https://Only.This.com/x "api": "c.d.io"', D.domain_findings(F.col("t"), F.lit("m.BIN"))) == ['"api": "c.d.io', "only.this.com"]


def test_context_of_functions_and_words(spark):
    text = "a" * 60 + "urlopen(" + "b" * 120 + " Malware"
    (got,) = findings(spark, text, D.function_findings(F.col("t")))
    assert got[3] == "urlopen " + "a" * 50 + "urlopen(" + "b" * 92 and got[5] == 60
    (got,) = findings(spark, text, D.control_findings(F.col("t")))
    assert got[2] == 0.95 and got[3].startswith("malware " + "b" * 29)
    assert [r[3][:3] for r in findings(spark, "say hoho", D.control_findings(F.col("t"), ["HOHO"]))] == ["hoh"]


def test_cloud_urls_once(spark):
    got = [(r[1], r[3]) for r in findings(spark, "s3://b/x s3://b/x gs://evil/y az://z", D.cloud_findings(F.col("t")))]
    assert got == [("INFO", "s3 s3://b/x"), ("WARNING", "gcs gs://evil/y"), ("INFO", "azure az://z")]


def test_secrets(spark):
    good, low = "ghp_" + "a1B2c3D4e5F6g7H8i9" * 2, "aaaaaaaaaaaaaaaaaaaaaaaa"
    text = f"{good} ghp_{'x' * 36} Bearer qW3eR5tY7uI9oP1aS2dF4 Bearer {low} api_key='Zx9Qw3Er7Ty1Ui5Op2As' sk-{'Ab1' * 16}"
    assert values(spark, text, D.secret_findings(F.col("t"))) == ["API key assignment", "Bearer token", "GitHub personal access token", "OpenAI API key"]


def test_explicit_network(spark):
    assert values(spark, "GET /x HTTP/1.1\nimport socket", D.explicit_findings(F.col("t"))) == ["http_request GET /x HTTP/1.1", "network_import import socket"]
    assert values(spark, "\x01\x02\x03" * 40 + "import socket" + "\x01" * 60, D.explicit_findings(F.col("t"))) == []


def test_dangerous_globals(spark):
    cases = {
        ("os", "system"): True,
        ("builtins", "eval"): True,
        ("builtins", "set"): False,
        ("anything", "getattr"): True,
        ("os.path", "join"): True,
        ("pip._internal.cli.main_parser", "x"): True,
        ("osx", "x"): False,
        ("collections", "OrderedDict"): False,
        ("operator", "attrgetter"): True,
        ("operator", "add"): False,
        (" Builtins", "execfile"): True,
        ("torch.hub", "load"): True,
        ("torch._utils", "_rebuild_tensor_v2"): False,
        ("ntpath", "x"): True,
        (V.EXTENSION, "x"): True,
        ("sklearn.tree", "Tree"): False,
    }
    got = each(spark, list(cases), V.dangerous_global(F.col("m"), F.col("f")), "m string, f string")
    assert dict(zip(cases, got, strict=True)) == cases
    assert each(spark, ["a.b_1", "PIL", "", "a..b", "1a", "a b", "_x"], V.plausible_module(F.col("t"))) == [True, False, False, False, False, False, True]
    allowed = each(spark, [("subprocess", "x"), ("subprocess", "run")], V.dangerous_global(F.col("m"), F.col("f"), ["subprocess x", "subprocess run"]), "m string, f string")
    assert allowed == [False, True]  # what always runs code is never allowed


def test_rules_of_findings(spark):
    rules = {"import os": "S101", "__import__('os')": "S101", "eval(x)": "S104", "../x": "S405", "A type and extension mismatch": "S901", "nothing": None}
    rows = spark.createDataFrame([(k,) for k in rules], "message string")
    assert {r.message: r.rule_code for r in match_rules(rows, built_in(spark)).collect()} == rules
    mapped = {"Archive bomb": "S410", "ipv4_address": "S308", "hex and url": "S309", "a url in hex": "S309", "hex": "S602", "protocol version 9": "S212", "timeout of unknown opcode": "S610", "timeout": None, "unknown operation": "S610"}
    assert dict(zip(mapped, each(spark, list(mapped), V.mapped_rule(F.col("t"))), strict=True)) == mapped
    assert each(spark, [("Os", None), ("builtins", "COMPILE"), ("builtins", "x"), ("dill", "x"), ("numpy", "x")], V.import_rule(F.col("m"), F.col("f")), "m string, f string") == ["S101", "S105", "S115", "S213", None]


@pytest.mark.parametrize("glob", ["a?.pkl", "*.pkl", "[ab]*", "[!ab]*", "x[", "a.b", "*/m?/[0-9].bin", "[]]x", "[^a]"])
def test_globs_are_shell_globs(glob):
    for name in ("a1.pkl", "a.pkl", "b", "c", "x[", "aXb", "a.b", "/q/m1/7.bin", "]x", "^", "a1.pkl\n"):
        assert bool(re.match(checks_.glob_regex(glob), name)) == fnmatch.fnmatchcase(name, glob) or glob == "[^a]", (glob, name)


def test_assets(spark):
    cases = {"/m/a.pkl (pos 3)": "/m/a.pkl", "/m/a.zip:in/b.pkl": "/m/a.zip", r"C:\m\a.pkl:inner": r"C:\m\a.pkl", "": "unknown", None: "unknown", " x y": "x", ":x": "unknown"}
    assert dict(zip(cases, each(spark, list(cases), checks_.asset_of(F.col("t"))), strict=True)) == cases


def test_operational_errors_mind_case(spark):
    cases = [("Permission denied: x", "warning"), ("permission denied", "warning"), ("Scan timeout after", "critical"), ("Scan timeout", "info"), ("module not installed", "warning"), ("x not installed, cannot scan", "warning"), ("Scan timeout", None)]
    assert each(spark, cases, C.operational_error(F.col("m"), F.col("s")), "m string, s string") == [True, False, True, False, False, True, False]


def test_documentation_and_templates(spark):
    assert each(spark, ["# a\nb", "# a\n# b\nc", "warning: x", "WARNING: x", "", "  note: y\r\n\n"], C.mostly_documentation(F.col("t"))) == [False, True, True, False, False, True]
    rows = spark.createDataFrame([("{% for message in messages %}{{ message['role'] }}{% if x.__class__.__mro__ %}",)], "t string")
    kinds = lambda framework: sorted(r.f.kind for r in rows.select(F.explode(C.template_findings(F.col("t"), framework)).alias("f")).collect())
    assert kinds(None) == ["control_flow", "object_traversal"] and kinds("huggingface") == ["object_traversal"]
    assert each(spark, ["{{a}}", "{#", "{% x", "{ x }"], C.is_template(F.col("t"))) == [True, False, False, False]


def test_encoded_code_is_read(spark):
    import base64

    hidden = base64.b64encode(b"x = os.system('id')  ").decode()
    text = f"a {hidden} b " + "".join(f"\\x{ord(c):02x}" for c in "eval(1)") + " " + "".join(f"\\u{ord(c):04x}" for c in "exec(2)") + " 'com' + 'pile(' + '3)'"
    rows = spark.createDataFrame([(text,)], "t string")
    got = {(r.encoding, r.match) for r in C.code_findings(rows, "t").collect()}
    assert {("deobfuscated_base64_encoded", "os.system"), ("deobfuscated_hex_encoded", "eval("), ("deobfuscated_unicode_escape", "exec("), ("deobfuscated_string_concat", "compile(")} <= got
    plain = {r.match: round(r.confidence, 6) for r in C.code_findings(spark.createDataFrame([("eval(x) # note",), ("os.system('x; y')",)], "t string"), "t").collect()}
    assert plain == {"eval(": 0.3, "os.system": 0.85}


def test_cves(spark):
    text = "import joblib\njoblib.load(x)\nos.system('id')"
    rows = spark.createDataFrame([(text,), ("# " + text.replace("\n", "\n# "),), ("RemoteModule unpickle",)], "t string")
    got = sorted((r.cve, round(r.confidence, 6), r.cvss) for r in C.cve_indicators(rows, "t").collect())
    assert got == [("CVE-2020-13092", 1.0, 9.8), ("CVE-2024-48063", 0.9, 9.8)]  # three signs; two: the context and the module's name


def test_code_analysis():
    assert code.risk("import os\nos.system('x')\nf = lambda *a, **k: eval('1')") == 2 + 8 + 8 + 10
    assert code.valid("x = 1") and not code.valid("return 1") and not code.valid("a b") and not code.valid("")
    assert code.behaviour("import os\nos.system('x')") == ("medium", 2) and code.behaviour("import os\nos.getenv('x')") == ("safe", -0.5)
    assert code.behaviour("a b") == ("medium", None)
    assert code.behaviour("eval(x)\nrequests(y)\nurllib(z)")[1] == 2 and code.behaviour("torch.load('a.pt')", "pytorch") == ("safe", -0.5)
    assert code.dangerous_string("eval('1')") == r"eval\s*\(" and code.dangerous_string("we eval( nothing") == r"eval\s*\("
    assert code.dangerous_string("compile ( nothing here") is None and code.dangerous_string("aB3+" * 30) is None and code.dangerous_string("aB3+/x" * 30) == "potential_base64"


def test_json_of_any_depth(spark):
    deep = "[" * 300 + "1" + "]" * 300
    rows = spark.createDataFrame([(1, '{"a": {"b": [true, null, {"c": 1e5}]}, "d": "x"}'), (2, deep), (3, "no json"), (4, None), (5, "{}")], "i int, t string")
    got = {}
    for r in C.json_walk(rows, "t", "i").collect():
        got.setdefault(r.i, []).append((r.key_path, r.value))
    assert got == {1: [("a.b[0]", "true"), ("a.b[1]", None), ("a.b[2].c", "1e5"), ("d", "x")], 2: [("[0]" * 300, "1")], 3: [("", "no json")], 4: [("", None)]}


def test_paths(spark):
    assert each(spark, ["a.tar.gz", "a.b.safetensors", "safetensors", ".bin", "a.txt", "A.PT"], K.scannable(F.col("t"))) == [True, True, False, False, False, True]
    assert each(spark, [("/a/b", "/a/b/c"), ("/a/b", "/a/b/../c"), ("/a/b", "/a/bc"), ("/a/b/", "/a/./b"), ("/", "/x")], K.within(F.col("b"), F.col("p")), "b string, p string") == [True, False, False, True, True]
    assert each(spark, ["/x/model-00001-of-00002.safetensors", "/x/a-model-1-of-2.safetensors", "/x/checkpoint_7.pt"], K.shard(F.col("t"))["number"]) == [1, None, 7]
    assert each(spark, [512, 1536, 5 << 30], K.size_text(F.col("t")), "t long") == ["512.0 B", "1.5 KB", "5.0 GB"]
    assert K.proto_pickle(b"(lp0\n.") and not K.proto_pickle(b"plain text") and K.proto_pickle(b"#(lp0\n.")


def test_byte_statistics(spark):
    source = "def a():\n    import os\n    return print(self.x)\n" * 6
    rows = spark.createDataFrame([(1, source), (2, ""), (3, "\x00" * 50), (4, "\r\n" * 8)], "i int, t string")
    got = {r.i: r for r in W.byte_statistics(rows, "i", "t").collect()}
    assert got[1].code_parts == 5 and got[1].code == 0.8 and got[2].entropy == 0 and got[3].nuls == 1 and abs(got[3].binary - 2 / 3) < 1e-9 and got[4].line_ends == 1.0
    assert [(r["at"], r.entropy) for r in W.sliding_entropy(rows.where("i = 3"), "i", "t").collect()] == [(0, 0.0)]


def test_repeating_weights(spark):
    import math
    import random

    noise = random.Random(1)
    rows = [(g, i, math.sin(i * math.pi / 8) if g == 1 else noise.gauss(0, 1)) for g in (1, 2) for i in range(1001)]
    values_ = spark.createDataFrame(rows, "g int, i int, v double")
    got = {r.g: r.n_peaks for r in W.repeating(values_, "g", "i", "v").collect()}
    assert got[1] >= 5 and got[2] == 0
    nines = spark.createDataFrame([(1, i, 9e-5) for i in range(1001)], "g int, i int, v double")
    assert W.benford(nines, "g", "i", "v").first().chi2 > 20


def test_limit_and_share_of_outliers_hold_for_any_size(spark, tmp_path):
    import duckdb

    from sluicework.plans.statistics_queries import QUERIES, SQL

    rows = [(i, [3.0 + (i % 2) * 0.1, 9.0 if i % 1000 == 7 else 1.0], 1) for i in range(12_000)]  # a large layer: by its size, 6 deviations and a thousandth
    rows += [(i, [1.0 + i % 5, None if i == 8 else 40.0 if i == 9 else 4.0], 2) for i in range(50)] + [(9, [30.0], 2), (60, [], 2), (61, None, 2)]
    rows += [(i, [3.0, 4.0], 3) for i in range(20)] + [(1, [1.0], 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, QUERIES["norm_outliers"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(SQL["norm_outliers"]).fetchall())
    assert len(want) == 13 and [x[:2] for x in got] == [x[:2] for x in want]
    assert all(abs(a - b) < 1e-4 for x, y in zip(got, want, strict=True) for a, b in zip(x[2:], y[2:], strict=True))
    by_size = W.norm_outliers(spark.read.parquet(f"{tmp_path}/embeddings.parquet"), "label", "vec_id", "embedding", 2.0)
    assert not by_size.where("label = 1 and abs(z) <= 6").count()


def test_decayed_mean_over_many_ranges(spark):
    xs = [float(i % 17) for i in range(3000)]
    mean = xs[0]
    for x in xs[1:]:
        mean = 0.9 * mean + 0.1 * x
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "k int, i int, v double").repartition(5)
    assert abs(W.decayed_mean(rows, "k", "i", "v").first()["mean"] - mean) < 1e-9


def test_signature_decisions(spark):
    cases = [("MZ", 0, 0.9, 1.0), ("MZ", 500, 0.1, 2.0), ("MZ", 500, 0.1, 9.0), ("#!/", 0, 0.7, 1.0), ("#!/", 0, 0.4, 0.0), ("#!/", 0, 0.55, 50.0), ("ELF", 2000, 0.9, 60.0), ("ELF", 10, 0.9, 60.0), ("PK", 9999, 1.0, 0.0)]
    got = each(spark, cases, W.coincidental(F.col("s"), F.col("o"), F.col("c"), F.col("d"), F.lit(8), F.lit(0.0), F.lit(1 << 20)), "s string, o int, c double, d double")
    assert got == [False, True, False, True, False, False, True, False, False]
