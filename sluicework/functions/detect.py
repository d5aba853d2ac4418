"""Detectors of text: each gives an array of findings for one text, as an expression.

A finding is type, severity, confidence, value, message and, where it is needed,
the position in characters. Detectors of one row are joined into one array and
exploded once, so a text is read once however many detectors there are.
Patterns are literals of an expression, so each is compiled once; documents are
never crossed with pattern tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tables as T

FINDING = "array<struct<type:string,severity:string,confidence:double,value:string,message:string,position:int>>"
#: Words of a version, words in urls that make them suspicious, ports of common back doors, endings of model files, hosts of frameworks, parts of layer names, placeholders of secrets.
VERSION_WORDS = ["version", "ver", "v.", "release", "build"]
URL_WORDS = ["eval", "exec", "cmd", "shell"]
URL_PORTS = [":1337", ":4444", ":31337"]
CLOUD_WORDS = ["malware", "exploit", "hack", "evil", "backdoor", "exfil"]
MODEL_ENDINGS = [".bin", ".pt", ".pth", ".ckpt", ".h5", ".pb", ".onnx"]
PORT_MODEL_ENDINGS = [*MODEL_ENDINGS, ".safetensors", ".pkl", ".pickle", ".joblib"]
FILE_ENDINGS = [".pkl", ".pt", ".h5", ".pb", ".onnx", ".json"]
FRAMEWORK_HOSTS = ["numpy.org", "pytorch.org", "tensorflow.org"]
LAYER_WORDS = ["layer", "weight", "bias", "conv", "bn", "norm", "fc", "dense"]
PLACEHOLDERS = ["example", "placeholder", "your_", "xxx", "****", "token_here", "sample", "test"]
EXPLICIT_DOMAINS = [r"https?://[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}", r"""["'](?:api|webhook|callback|endpoint)["']:\s*["'][a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}"""]
URL = "(?i)" + T.URL.replace("#[", r"#\[")  # a bracket in a class must be escaped for Java
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
#: Parts in lower case of which each match has one: a text without them needs no regular expression.
SECRET_PARTS = [["ghp_"], ["gho_"], ["ghu_"], ["ghs_"], ["ghr_"], ["sk-"], ["akia"], ["xox"], ["bearer"], ["key", "token"]]
LICENSE_PARTS = ["licen", "apache", "bsd", "gpl", "commons", "cc", "odbl", "pddl", "rail"]
NETWORK_PARTS = {"url": ["://"], "socket_connection": ["socket.connect"], "http_request": ["http/1."], "network_import": ["import"]}
KNOWN_SECRETS = ["github", "openai", "aws", "slack"]


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def found(text: Column, pattern: str) -> Column:
    """value, position of all matches of a pattern, by the pieces between them: no pattern looks around a match."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(values)).alias("piece"), values.alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<value:string,position:int>>)").alias("out"))

    def step(a, x):
        at = a["at"] + F.length(x["piece"])
        return F.struct((at + F.length(x["value"])).alias("at"), F.concat(a["out"], F.array(F.struct(x["value"].alias("value"), at.alias("position")))).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(between, start, step, lambda a: a["out"])).otherwise(F.expr("cast(array() as array<struct<value:string,position:int>>)"))


def around(text: Column, position: Column, length: Column, before: int, after: int) -> Column:
    """What stands around a place of the text, the place included."""
    begin = F.greatest(position - before, F.lit(0))
    return F.substr(text, begin + 1, position - begin + length + after)


def finding(kind: str, severity: Column, confidence: Column, value: Column, message: Column, position: Column | None = None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        severity.alias("severity"),
        confidence.cast("double").alias("confidence"),
        value.alias("value"),
        message.alias("message"),
        (F.lit(None) if position is None else position).cast("int").alias("position"),
    )


def _clip(prefix: str, value: Column, n: int) -> Column:
    return F.concat(F.lit(prefix), F.left(value, F.lit(n)))


def _some(hits: list[Column]) -> Column:
    return F.array_compact(F.array(*hits)).cast(FINDING)


def entropy(text: Column) -> Column:
    """Shannon entropy of a string's characters, in bits. For short strings: it sorts them."""
    signs = F.array_sort(F.split(text, ""))
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(signs), lambda c: F.size(F.filter(signs, lambda x: x == c)) / n)
    return F.when(F.length(text) == 0, 0.0).otherwise(-F.aggregate(each, F.lit(0.0), lambda a, p: a + p * F.log2(p)))


def url_findings(text: Column) -> Column:
    def one(m):
        url = m["value"]
        confidence = (
            F.when(any_of(F.lower(url), URL_WORDS), 0.9)
            .when(any_of(url, URL_PORTS), 0.8)
            .when(~(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://"))), 0.7)
            .otherwise(0.5)
        )
        return finding("url_detected", F.when(confidence > 0.7, "HIGH").otherwise("MEDIUM"), confidence, url, _clip("URL detected in model: ", url, 100), m["position"])

    return F.transform(found(text, URL), one).cast(FINDING)


def cloud_findings(text: Column) -> Column:
    """Each distinct url once, of the first pattern that finds it; its value is "provider url"."""

    def of(pattern: str, description: str, provider: str) -> Column:
        values = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
        return F.transform(values, lambda u: F.struct(u.alias("url"), F.lit(description).alias("description"), F.lit(provider).alias("provider")))

    all_ = F.concat(*[of(*x) for x in T.CLOUD])
    first = F.filter(all_, lambda x, k: ~F.exists(F.slice(all_, 1, k), lambda y: y["url"] == x["url"]))

    def one(x):
        bad = any_of(F.lower(x["url"]), CLOUD_WORDS)
        message = F.concat(x["description"], F.lit(" detected: "), F.left(x["url"], F.lit(150)))
        return finding("cloud_storage_url", F.when(bad, "WARNING").otherwise("INFO"), F.when(bad, 0.95).otherwise(0.9), F.concat(x["provider"], F.lit(" "), x["url"]), message)

    return F.when(text.rlike("(?i)s3|gs://|google|az://|azure|wasbs?://|abfss?://|windows\\.net|huggingface"), F.transform(first, one)).otherwise(F.array()).cast(FINDING)


def _octet(ip: Column, i: int) -> Column:
    return F.get(F.split(ip, r"\."), i).cast("int")


def private_ip(ip: Column) -> Column:
    """Loopback, private use, link local, this network and the other special ranges of the registry."""
    a, b, c, d = (_octet(ip, i) for i in range(4))
    return (
        a.isin(0, 10, 127)
        | ((a == 172) & b.between(16, 31))
        | ((a == 192) & (b == 168))
        | ((a == 169) & (b == 254))
        | ((a == 192) & (b == 0) & (c == 2))
        | ((a == 192) & (b == 0) & (c == 0) & ~d.isin(9, 10))
        | ((a == 198) & b.isin(18, 19))
        | ((a == 198) & (b == 51) & (c == 100))
        | ((a == 203) & (b == 0) & (c == 113))
        | (a >= 240)
    )


def ipv4_findings(text: Column) -> Column:
    """Addresses, but for versions, short numbers in quotes, and numbers of a list of weights, as the 20 characters on both sides tell."""

    def kept(m):
        ip, near = m["value"], F.lower(around(text, m["position"], F.length(m["value"]), 20, 20))
        quoted = F.contains(near, F.concat(F.lit('"'), ip, F.lit('"'))) | F.contains(near, F.concat(F.lit("'"), ip, F.lit("'")))
        small = _octet(ip, 0) < 100
        for i in (1, 2, 3):
            small = small & (_octet(ip, i) < 100)
        bracket = (F.contains(near, F.lit("[")) & F.contains(near, F.lit("]"))) | (F.contains(near, F.lit("{")) & F.contains(near, F.lit("}")))
        return ~any_of(near, VERSION_WORDS) & ~(quoted & small) & ~(bracket & any_of(near, [".0", "float", "weight", "bias"])) & ~ip.rlike(r"(^|\.)0\d")

    def one(m):
        private = private_ip(m["value"])
        shared = (_octet(m["value"], 0) == 100) & _octet(m["value"], 1).between(64, 127)
        return finding("ipv4_address", F.lit("MEDIUM"), F.when(private, 0.3).when(shared, 0.4).otherwise(0.7), m["value"], F.concat(F.lit("IPv4 address detected: "), m["value"]), m["position"])

    return F.transform(F.filter(found(text, T.IPV4), kept), one).cast(FINDING)


def ipv6_findings(text: Column) -> Column:
    return F.transform(found(text, T.IPV6), lambda m: finding("ipv6_address", F.lit("MEDIUM"), F.lit(0.6), m["value"], F.concat(F.lit("IPv6 address detected: "), m["value"]), m["position"])).cast(FINDING)


def domain_findings(text: Column, context: Column) -> Column:
    """Domains once each. In model files only those of whole urls and of settings count."""
    explicit = F.concat(*[F.regexp_extract_all(text, F.lit(f"(?i){p}"), F.lit(0)) for p in EXPLICIT_DOMAINS])
    explicit = F.array_distinct(F.transform(explicit, lambda x: F.lower(F.when(F.contains(x, F.lit("://")), F.substring_index(F.substring_index(x, "://", -1), "/", 1)).otherwise(x))))
    of_model = F.transform(explicit, lambda d: finding("domain", F.lit("MEDIUM"), F.lit(0.8), d, F.concat(F.lit("Domain name detected: "), d)))
    every = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(T.DOMAIN), F.lit(0)), F.lower))

    def kept(d):
        parts = F.split(d, r"\.")
        short = (F.size(parts) == 2) & (F.length(F.get(parts, 0)) <= 2) & (F.length(F.get(parts, 1)) <= 2)
        return ~F.rlike(d, F.lit("(" + "|".join(e.replace(".", r"\.") for e in FILE_ENDINGS) + ")$")) & ~d.isin(*FRAMEWORK_HOSTS) & ~any_of(d, LAYER_WORDS) & ~short & F.element_at(parts, -1).isin(*T.DOMAIN_ENDINGS)

    def one(d):
        confidence = F.when(any_of(d, ["malware", "evil", "hack", "exploit"]), 0.9).when(F.element_at(F.split(d, r"\."), -1).isin(*T.SUSPICIOUS_ENDINGS), 0.7).otherwise(0.3)
        return finding("domain_name", F.when(confidence < 0.7, "MEDIUM").otherwise("HIGH"), confidence, d, F.concat(F.lit("Domain name detected: "), d))

    return F.when(any_of(F.lower(context), MODEL_ENDINGS), of_model.cast(FINDING)).otherwise(F.transform(F.filter(every, kept), one).cast(FINDING))


def library_findings(text: Column) -> Column:
    hits = []
    for lib in T.LIBRARIES:
        bad = lib in ("socket", "paramiko", "pycurl")
        forms = [f"import {lib}", f"from {lib}", f"{lib}.connect", f"{lib}.request", f"{lib}.__init__"]
        one = finding("network_library", F.lit("CRITICAL" if bad else "HIGH"), F.lit(0.8 if bad else 0.7), F.lit(lib), F.lit(f"Network library detected: {lib}"))
        hits.append(F.when(F.contains(text, F.lit(lib)) & any_of(text, forms), one))
    return _some(hits)


def function_findings(text: Column) -> Column:
    """The value is what stands around the first call."""
    hits = []
    for name in T.NETWORK_FUNCTIONS:
        bad = "socket.connect" in name or "requests." in name
        at = F.instr(text, name) - 1
        snippet = F.concat(F.lit(f"{name} "), around(text, at, F.lit(0), 50, 100))
        hits.append(F.when(at >= 0, finding("network_function", F.lit("CRITICAL" if bad else "HIGH"), F.lit(0.8 if bad else 0.6), snippet, F.lit(f"Network function call detected: {name}"), at)))
    return _some(hits)


def control_findings(text: Column, words: Sequence[str] = ()) -> Column:
    """Words of control servers, ``words`` of the caller included. The value is what stands around the first."""
    hits, low = [], F.lower(text)
    for w in [*T.CONTROL_WORDS, *(w.lower() for w in words)]:
        at = F.instr(low, w) - 1
        confidence = 0.95 if w in ("malware", "backdoor", "trojan", "botnet") else 0.8
        hits.append(F.when(at >= 0, finding("cc_pattern", F.lit("CRITICAL"), F.lit(confidence), F.concat(F.lit(f"{w} "), around(text, at, F.lit(len(w)), 30, 30)), F.lit(f"C&C pattern detected: {w}"), at)))
    return _some(hits)


def port_findings(text: Column) -> Column:
    """":22" is also found in ":2222"."""
    hits = []
    for p in T.PORTS:
        service = T.SERVICES.get(p, "Unknown")
        hit = any_of(text, [f":{p}", f"port={p}", f"port {p}", f"PORT={p}"])
        hits.append(F.when(hit, finding("suspicious_port", F.lit("MEDIUM"), F.lit(0.6), F.lit(str(p)), F.lit(f"Suspicious port detected: {p} ({service})"))))
    return _some(hits)


def explicit_findings(text: Column) -> Column:
    """Network use that says so, in readable surroundings: what model files are held against in place of ports."""

    def readable(m):
        near = around(text, m["position"], F.length(m["value"]), 100, 100)
        return F.length(F.regexp_replace(near, UNPRINTABLE, "")) > 0.7 * F.length(near)

    def of(pattern: str, kind: str) -> Column:
        def one(m):
            return finding("explicit_network_pattern", F.lit("CRITICAL"), F.lit(0.95), F.concat(F.lit(f"{kind} "), F.left(m["value"], F.lit(200))), _clip("Explicit network pattern in ML model: ", m["value"], 100))

        hits = F.transform(F.filter(found(text, f"(?i){pattern}"), readable), one).cast(FINDING)
        return F.when(any_of(low, NETWORK_PARTS[kind]), hits).otherwise(F.expr("array()").cast(FINDING))

    low = F.lower(text)
    return F.concat(*[of(*x) for x in T.EXPLICIT_NETWORK])


def blacklist_findings(text: Column, domains: Sequence[str]) -> Column:
    low = F.lower(text)
    return _some([F.when(F.contains(low, F.lit(d.lower())), finding("blacklisted_domain", F.lit("CRITICAL"), F.lit(1.0), F.lit(d.lower()), F.lit(f"Blacklisted domain detected: {d.lower()}"))) for d in domains] or [F.lit(None).cast(FINDING[6:-1])])


def network_array(text: Column, context: Column, blacklist: Sequence[str] = (), words: Sequence[str] = ()) -> Column:
    """The findings of all network detectors on one text. ``context`` is the name of the file."""
    ports = F.when(any_of(F.lower(context), PORT_MODEL_ENDINGS), explicit_findings(text)).otherwise(port_findings(text))
    return F.concat(
        url_findings(text),
        cloud_findings(text),
        ipv4_findings(text),
        ipv6_findings(text),
        domain_findings(text, context),
        library_findings(text),
        function_findings(text),
        control_findings(text, words),
        ports,
        blacklist_findings(text, blacklist),
    )


def explode_findings(rows: DataFrame, findings: Column, *keep: str) -> DataFrame:
    """keep, type, severity, confidence, value, message, position: one row a finding."""
    return rows.select(*keep, F.explode(findings).alias("f")).select(*keep, "f.*")


def secret_findings(text: Column) -> Column:
    """Secrets that are no placeholder; kinds without a form of their own need 16 characters and 4 bits of entropy. The value is the kind, the position the length."""

    def secret(x):
        bearer = F.contains(x["match"], F.lit("Bearer")) & F.contains(x["match"], F.lit(" "))
        return F.when(bearer, F.trim(F.regexp_extract(x["match"], r"^[^ ]* (.*)$", 1))).otherwise(x["secret"])

    low, none = F.lower(text), F.expr("array()").cast(FINDING)

    def of(pattern: str, kind: str, parts: list[str]) -> Column:
        known, group = any(k in kind.lower() for k in KNOWN_SECRETS), 1 if "([" in pattern else 0
        matches = F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(0))
        if group:
            pairs = F.arrays_zip(matches.alias("match"), F.regexp_extract_all(text, F.lit(f"(?i){pattern}"), F.lit(group)).alias("secret"))
        else:
            pairs = F.transform(matches, lambda m: F.struct(m.alias("match"), m.alias("secret")))

        def kept(x):
            real = ~any_of(F.lower(x["match"]), PLACEHOLDERS)
            return real if known else real & (F.length(secret(x)) >= 16) & (entropy(secret(x)) >= 4.0)

        def one(x):
            return finding("exposed_secret", F.lit("INFO"), F.lit(1.0), F.lit(kind), F.lit(f"Potential exposed secret in text metadata: {kind}"), F.length(secret(x)))

        return F.when(any_of(low, parts), F.transform(F.filter(pairs, kept), one).cast(FINDING)).otherwise(none)

    return F.concat(*[of(*x, parts) for x, parts in zip(T.SECRETS, SECRET_PARTS, strict=True)])


def license_array(text: Column, lines: int = 50) -> Column:
    """spdx_id, name, commercial_allowed of each licence that the first lines name."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")

    def of(h: Column) -> Column:
        hit = [F.when(h.rlike(f"(?im){p}"), F.struct(F.lit(k).alias("spdx_id"), F.lit(n).alias("name"), F.lit(free).alias("commercial_allowed"))) for p, k, n, free in T.LICENSES]
        return F.array_compact(F.array(*hit))

    one = F.get(F.transform(F.array(head), of), F.lit(0))  # the head is worked out once for all patterns
    none = F.expr("cast(array() as array<struct<spdx_id:string,name:string,commercial_allowed:boolean>>)")
    return F.when(any_of(F.lower(text), LICENSE_PARTS), one).otherwise(none)


def licenses(rows: DataFrame, text: str, *keep: str, lines: int = 50) -> DataFrame:
    """keep, spdx_id, name, commercial_allowed: each licence that the first lines name."""
    return rows.select(*keep, F.explode(license_array(F.col(text), lines)).alias("f")).select(*keep, "f.*")


def copyrights(rows: DataFrame, text: str, *keep: str, lines: int = 50) -> DataFrame:
    """keep, year, holder of every notice in the first lines, once for each form that finds it."""
    head = F.concat(F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n"), F.lit("\n"))
    both = [
        F.arrays_zip(F.regexp_extract_all(head, F.lit(f"(?im){p}"), F.lit(1)).alias("year"), F.regexp_extract_all(head, F.lit(f"(?im){p}"), F.lit(2)).alias("holder"))
        for p in T.COPYRIGHTS
    ]
    return rows.select(*keep, F.explode(F.concat(*both)).alias("f")).select(*keep, F.trim("f.year").alias("year"), F.trim("f.holder").alias("holder"))
