"""Queries of statistics on text, bytes and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tables as T
from ..operators import weights as W
from .data import quoted, table

QUERIES, SQL = {}, {}


def _add(sql: str):
    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


_BYTES = "SELECT doc_id, spot_at, substring(h, spot_at::BIGINT * 2 + 1, 2) AS b, n FROM (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS n, unnest(range(0, strlen(text))) AS spot_at FROM documents)"
_ENTROPY = """c AS (SELECT {key}, b, count(*) AS k FROM {rows} GROUP BY ALL), e AS (SELECT {key}, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy FROM c GROUP BY ALL)"""
_PARTS = " + ".join(f"contains(text, {quoted(x.decode())})::INT" for x in W.CODE_PARTS)
_STATS = f"""b AS ({_BYTES}), {_ENTROPY.format(key='doc_id', rows='b')},
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (b BETWEEN '20' AND '7E') / count(*) AS printable, count(*) FILTER (b = '0A') AS ends, count(*) FILTER (b = '00') / count(*) AS nuls FROM b GROUP BY doc_id),
p AS (SELECT doc_id, ({_PARTS})::BIGINT AS code_parts, len(regexp_extract_all(text, chr(13) || chr(10))) AS crlf FROM documents),
a AS (SELECT doc_id, n, entropy, printable, (ends + crlf) / n AS line_ends, nuls, code_parts FROM n JOIN e USING (doc_id) JOIN p USING (doc_id)),
s AS (SELECT *, ((printable > 0.7 AND printable < 0.95)::INT + (line_ends > 0.01 AND line_ends < 0.1)::INT + (nuls < 0.01)::INT + (code_parts >= 3)::INT + (entropy BETWEEN 5 AND 7)::INT) / 5.0 AS c,
 ((entropy > 7.5)::INT + (nuls > 0.1)::INT + (printable < 0.3)::INT) / 3.0 AS "binary" FROM a), t AS (SELECT *, CASE WHEN "binary" > 0.5 THEN c * (1 - "binary") ELSE c END AS code FROM s)"""


@_add(f"WITH {_STATS} SELECT doc_id, round(entropy, 6) AS entropy, round(printable, 6) AS printable, round(line_ends, 6) AS line_ends, round(nuls, 6) AS nuls, code_parts, round(code, 6)::DOUBLE AS code, round(\"binary\", 6)::DOUBLE AS \"binary\" FROM t")
def byte_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    return _rounded(W.byte_statistics(docs, "doc_id", "text"))


@_add(f"""WITH {_STATS}, r AS (SELECT doc_id, list_filter([{{'t': 'ml_weights', 'c': CASE WHEN doc_id % 3 = 0 AND doc_id % 7 > 4 THEN 0.9 * (doc_id % 7) / 6.0 END}}, {{'t': 'code', 'c': CASE WHEN code > 0.6 THEN code END}}, {{'t': 'binary_data', 'c': CASE WHEN "binary" > 0.7 THEN "binary" END}},
{{'t': 'random_data', 'c': CASE WHEN entropy > 7.5 THEN 0.8 END}}], lambda x: x.c IS NOT NULL) AS l, n FROM t)
SELECT doc_id, CASE WHEN n < 16 OR len(l) = 0 THEN 'unknown' ELSE list_filter(l, lambda x: x.c = list_max(list_transform(l, lambda y: y.c)))[1].t END AS type FROM r""")
def data_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    sizes = docs.select(F.col("doc_id").alias("of"), F.octet_length("text").alias("n"))
    rows = W.byte_statistics(docs, "doc_id", "text").join(sizes, F.col("doc_id") == F.col("of"))
    floats, weight = F.when(F.col("doc_id") % 3 == 0, 1.0).otherwise(0.5), (F.col("doc_id") % 7) / 6.0
    return rows.select("doc_id", W.data_type(F.col("n"), floats, F.when(F.col("doc_id") % 7 > 4, weight).otherwise(0.0), F.col("code"), F.col("binary"), F.col("entropy"))["type"].alias("type"))


@_add(f"WITH b AS ({_BYTES}), {_ENTROPY.format(key='doc_id', rows='b')} SELECT doc_id, round(entropy, 6) AS entropy FROM e")
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("length(text) > 0")
    return _rounded(W.byte_statistics(docs, "doc_id", "text").select("doc_id", "entropy"))


@_add(f"""WITH b AS ({_BYTES}), w AS (SELECT doc_id, b, spot FROM (SELECT doc_id, b, n, unnest(CASE WHEN n < 256 THEN [0] ELSE [(spot_at // 128) * 128, (spot_at // 128) * 128 - 128] END) AS spot FROM b) WHERE spot >= 0 AND (n < 256 OR spot + 256 <= n)),
{_ENTROPY.format(key='doc_id, spot', rows='w')} SELECT doc_id, spot::BIGINT AS "at", round(entropy, 6) AS entropy FROM e""")
def sliding_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.sliding_entropy(table(spark, sf_dir, "documents").where("length(text) > 0"), "doc_id", "text"))


_LONG = "v AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_BINS = """(CASE WHEN hi = lo THEN 25 ELSE least(floor((x - lo) / (hi - lo) * 50), 49) END)::INT"""


def _floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("size", F.col("vec_id") * 1_000_000)
    return W.float_statistics(rows, "vec_id", "embedding", "size")


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))


@_add(f"""WITH {_LONG}, m AS (SELECT vec_id, min(x) AS lo, max(x) AS hi, avg(x) AS mean, stddev_pop(x) AS std, quantile_cont(x, 0.95) AS p95, count(*) AS n FROM v GROUP BY vec_id),
c AS (SELECT vec_id, {_BINS} AS bin, count(*) AS k FROM v JOIN m USING (vec_id) GROUP BY ALL), e AS (SELECT vec_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy FROM c GROUP BY vec_id)
SELECT vec_id, 1.0::DOUBLE AS ratio, round(entropy, 5) AS entropy, round(((mean > -0.1 AND mean < 0.1)::INT + (std > 0.01 AND std < 2)::INT + (p95 < 3)::INT) / 3.0, 5)::DOUBLE AS weight FROM m JOIN e USING (vec_id)""")
def float_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_floats(spark, sf_dir).drop("confidence"), 5)


@_add(f"""WITH {_LONG.replace('unnest(embedding)::DOUBLE AS x', 'unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS i')}, s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS d FROM v WHERE i % 2 = 0 GROUP BY vec_id),
r AS (SELECT vec_id, avg((abs(x - m) <= 3 * d)::INT) AS near, avg((x BETWEEN -10 AND 10)::INT) AS small FROM v JOIN s USING (vec_id) WHERE i % 2 = 0 GROUP BY vec_id),
p AS (SELECT vec_id, avg((abs(x) < 1e10 AND (x = 0 OR abs(x) > 1e-10))::INT) AS ok FROM v GROUP BY vec_id)
SELECT vec_id, round(0.4 * ok + 0.3 * near + 0.1 * small + 0.2 * least(vec_id * 1000000 / 104857600.0, 1), 5) AS confidence FROM p JOIN r USING (vec_id)""")
def weight_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_floats(spark, sf_dir).select("vec_id", "confidence"), 5)


_SIGNS = ["MZ", "#!/", "ELF", "Mach-O"]


@_add(f"""WITH s AS (SELECT doc_id, ([{', '.join(map(quoted, _SIGNS))}])[(doc_id % 4 + 1)::INT] AS sign, (doc_id % 13) * 200 AS off, (doc_id % 11) / 10.0 AS conf, doc_id % 17 AS k, n_chars * 100000 AS size FROM documents),
d AS (SELECT *, CASE WHEN size > 0 THEN k / (size / 1048576.0) ELSE 0 END AS dens, CASE WHEN size < 3 THEN 0 ELSE greatest(size - 2, 1) / 16777216.0 END AS expd FROM s)
SELECT doc_id, round(dens, 6)::DOUBLE AS density, round(expd, 6)::DOUBLE AS expected, CASE sign WHEN 'MZ' THEN off > 100 AND (conf > 0.3 OR dens < 5)
 WHEN '#!/' THEN (conf > 0.6 AND (k <= expd * CASE WHEN least(size / 104857600.0, 1) > 0.5 THEN 10 + (conf - 0.6) * 25 ELSE 5 + (conf - 0.6) * 12.5 END OR dens < 2)) OR (conf > 0.5 AND (dens < 1 OR dens > 100))
 WHEN 'ELF' THEN off >= 1024 AND conf > 0.8 AND dens > 50 ELSE false END AS chance FROM d""")
def executable_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    sign, offset = F.element_at(F.array(*[F.lit(x) for x in _SIGNS]), (i % 4 + 1).cast("int")), (i % 13) * 200
    n, size, confidence = i % 17, F.col("n_chars") * 100_000, (i % 11) / 10.0
    density, expected = W.pattern_density(n, size), W.expected_patterns(size)
    out = table(spark, sf_dir, "documents").select("doc_id", density.alias("density"), expected.alias("expected"), W.coincidental(sign, offset, confidence, density, n, expected, size).alias("chance"))
    return _rounded(out)


@_add(f"""WITH {_LONG}, m AS (SELECT label, min(x) AS lo, max(x) AS hi FROM v GROUP BY label), c AS (SELECT label, {_BINS} AS bin, count(*) AS k FROM v JOIN m USING (label) GROUP BY ALL),
e AS (SELECT label, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS entropy FROM c GROUP BY label)
SELECT v.label, round(avg(x), 5) AS mean, round(stddev_pop(x), 5) AS std, round(min(x), 5) AS low, round(max(x), 5) AS high, round(quantile_cont(x, 0.05), 5) AS p05, round(quantile_cont(x, 0.5), 5) AS p50, round(quantile_cont(x, 0.95), 5) AS p95,
round(kurtosis_pop(x), 4) AS kurtosis, round((avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow(stddev_pop(x), 3), 4) AS skewness, round(avg((abs(x) < 1e-8)::INT), 5) AS zero_ratio, round(any_value(entropy), 4) AS entropy FROM v JOIN e ON v.label = e.label GROUP BY v.label""")
def weight_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = _long(spark, sf_dir)
    out = W.profile(long, "label", "x")
    entropy = W.histogram_entropy(long, "label", "x").withColumnRenamed("label", "of_label")
    r = lambda c, d=5: F.round(c, d)
    out = out.join(entropy, F.col("label") == F.col("of_label"))
    return out.select("label", *[r(c).alias(c) for c in ("mean", "std", "low", "high", "zero_ratio")], r(F.get("percentiles", 1)).alias("p05"), r(F.get("percentiles", 3)).alias("p50"), r(F.get("percentiles", 5)).alias("p95"), *[r(c, 4).alias(c) for c in ("kurtosis", "skewness", "entropy")])


_NAMES = ["conv1.weight", "encoder.dense", "self.attn.q", "token_embed", "bn2", "block", "query_proj", "fc.conv", "norm_key"]
_KIND = "CASE label % 9 WHEN 0 THEN 'conv2d_weights' WHEN 1 THEN 'dense_weights' WHEN 2 THEN 'attention_weights' WHEN 3 THEN 'embedding_weights' WHEN 4 THEN 'batch_norm_weights' WHEN 5 THEN 'conv2d_weights' WHEN 6 THEN 'attention_weights' WHEN 7 THEN 'conv2d_weights' ELSE 'attention_weights' END"
_PROFILES = ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in T.LAYER_PROFILES.items())


@_add(f"""WITH {_LONG}, p AS (SELECT label, {_KIND} AS kind, avg(x) AS m, stddev_pop(x) AS s, min(x) AS lo, max(x) AS hi, (avg(x * x * x) - 3 * avg(x) * avg(x * x) + 2 * pow(avg(x), 3)) / pow(stddev_pop(x), 3) AS sk, kurtosis_pop(x) AS ku, avg((x = 0)::INT) AS sp FROM v GROUP BY label),
e AS (SELECT * FROM (VALUES {_PROFILES}) t(kind, em, es, elo, ehi, esk, eku, esp))
SELECT label, kind, round((abs(m - em) / es + abs(ln(s / es)) + abs((hi - lo) - (ehi - elo)) / (ehi - elo) + abs(sk - esk) + abs(ku - eku) / 10 + abs(sp - esp) * 10) / 6, 4) AS distance FROM p JOIN e USING (kind)""")
def layer_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("label") % 9 + 1).cast("int"))
    out = W.profile(_long(spark, sf_dir), "label", "x").withColumn("kind", W.layer_type(name, F.when(F.col("label") % 9 == 5, 4).otherwise(2)))
    return _rounded(out.select("label", "kind", W.profile_distance(*[F.col(c) for c in ("kind", "mean", "std", "low", "high", "skewness", "kurtosis", "sparsity")]).alias("distance")), 4)


@_add(f"""WITH {_LONG}, n AS (SELECT label, vec_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY ALL), s AS (SELECT label, avg(norm) AS m, stddev_pop(norm) AS d, count(*) AS k FROM n GROUP BY label),
o AS (SELECT n.label, vec_id, norm, (norm - m) / d AS z, k FROM n JOIN s ON n.label = s.label WHERE abs((norm - m) / d) > 2) SELECT label, vec_id, round(norm, 5) AS norm, round(z, 4) AS z FROM o QUALIFY count(*) OVER (PARTITION BY label) / k < 0.06""")
def norm_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = W.norm_outliers(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 2.0, 0.06)
    return out.select("label", "vec_id", F.round("norm", 5).alias("norm"), F.round("z", 4).alias("z"))


@_add("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 8.0 WHEN l_quantity::BIGINT * 1000 > 10000 OR l_linenumber * 1000 > 2048 OR l_quantity::BIGINT * 1000 * l_linenumber * 1000 > 10000000 THEN 6.0 ELSE 3.0 END::DOUBLE AS deviations,
CASE WHEN l_linenumber = 1 THEN 0.0001 WHEN l_quantity::BIGINT * 1000 > 10000 OR l_linenumber * 1000 > 2048 OR l_quantity::BIGINT * 1000 * l_linenumber * 1000 > 10000000 THEN 0.001 ELSE 0.01 END::DOUBLE AS share FROM lineitem""")
def outlier_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = F.col("l_linenumber").cast("long") * 1000, F.col("l_quantity").cast("long") * 1000
    deviations, share = W.outlier_limits(n, q, F.col("l_linenumber") == 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", deviations.cast("double").alias("deviations"), share.alias("share"))


@_add(f"""WITH {_LONG}, s AS (SELECT label, avg(abs(x)) + 3.2 * stddev_pop(abs(x)) AS lim FROM v GROUP BY label), c AS (SELECT v.label, count(*) AS n_extreme, count(DISTINCT vec_id) AS n_neurons FROM v JOIN s ON v.label = s.label WHERE abs(x) > lim GROUP BY v.label),
k AS (SELECT label, greatest(20, floor(count(*) * 0.001)) AS most FROM embeddings GROUP BY label) SELECT c.* FROM c JOIN k USING (label) WHERE n_neurons <= most""")
def extreme_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.extreme_weights(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 3.2, 20)


@_add("""WITH u AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.label, a.vec_id, round(avg(list_cosine_similarity(a.e, b.e)), 5) AS similarity FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY ALL""")
def mean_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.mean_cosine(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("similarity", F.round("similarity", 5))


_ORDERED = "o AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) AS n FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS pos FROM embeddings)), k AS (SELECT label FROM o GROUP BY label HAVING count(*) >= 1000)"


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir).withColumn("place", F.struct("vec_id", "pos"))


@_add(f"""WITH {_ORDERED}, v AS (SELECT o.* FROM o JOIN k USING (label) WHERE n <= 1000), p AS (SELECT label, sum(x * x) AS power FROM v GROUP BY label),
c AS (SELECT a.label, b.n - a.n AS lag, sum(a.x * b.x) AS s FROM v a JOIN v b ON a.label = b.label AND b.n - a.n BETWEEN 10 AND 99 GROUP BY ALL)
SELECT p.label, (count(*) FILTER (s / power > 0.8))::INT AS n_peaks FROM p JOIN c ON p.label = c.label GROUP BY p.label""")
def repeating_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.repeating(_ordered(spark, sf_dir), "label", "place", "x")


@_add(f"""WITH {_ORDERED}, z AS (SELECT label, x, row_number() OVER (PARTITION BY label ORDER BY n) AS i, count(*) OVER (PARTITION BY label) AS k FROM o WHERE x <> 0), f AS (SELECT label, regexp_extract(format('{{:.10e}}', abs(x)), '([1-9])', 1)::INT AS d FROM z WHERE i <= 1000 AND k > 1000),
c AS (SELECT label, d, count(*) AS n FROM f GROUP BY ALL), g AS (SELECT DISTINCT label FROM c), e AS (SELECT label, unnest(range(1, 10)) AS d FROM g)
SELECT e.label, round(sum(pow(coalesce(n, 0) / 1000.0 - log10(1 + 1.0 / e.d), 2) / log10(1 + 1.0 / e.d)), 6) AS chi2 FROM e LEFT JOIN c ON c.label = e.label AND c.d = e.d GROUP BY e.label""")
def first_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(W.benford(_ordered(spark, sf_dir), "label", "place", "x"))


_SHAPES = "m AS (SELECT l_orderkey % 300 AS model, l_quantity::BIGINT * 48 AS r, CASE l_linenumber WHEN 1 THEN 50000 ELSE l_linenumber * 256 END::BIGINT AS c FROM lineitem)"
_DIM = "(list_contains({d}, {x}) OR len(list_filter({d}, lambda t: {x} % t = 0 AND {x} / t <= 16)) > 0)"
_DIMS = str(W.TRANSFORMER_DIMS)


@_add(f"""WITH {_SHAPES}, d AS (SELECT model, x, count(*) AS k FROM (SELECT model, r AS x FROM m UNION ALL SELECT model, c FROM m) GROUP BY ALL), q AS (SELECT model, count(*) FILTER (k >= 3) AS repeated_dims FROM d GROUP BY model),
s AS (SELECT model, sum({_DIM.format(d=_DIMS, x='r')}::INT + {_DIM.format(d=_DIMS, x='c')}::INT)::BIGINT AS matching_dims, count(*) FILTER (len(list_filter({W.VOCABULARIES}, lambda v: abs(c - v) < v * 0.05)) > 0) AS vocabularies, sum(r * c)::BIGINT AS parameters, count(*) AS n, max(greatest(r, c)) AS g FROM m GROUP BY model),
a AS (SELECT *, round((CASE WHEN matching_dims > n * 0.6 THEN 0.3 ELSE 0 END) + (CASE WHEN g >= 768 THEN 0.2 ELSE 0 END) + (CASE WHEN repeated_dims > 0 THEN 0.2 ELSE 0 END) + (CASE WHEN parameters > 100000000 THEN 0.3 WHEN parameters > 10000000 THEN 0.2 ELSE 0 END), 6)::DOUBLE AS confidence FROM s JOIN q USING (model)),
b AS (SELECT *, confidence > 0.7 AND (vocabularies > 0 OR parameters > 50000000) AS sure FROM a)
SELECT model, matching_dims, vocabularies, repeated_dims, parameters, confidence, parameters > 100000000 OR sure AS is_llm, matching_dims > n * 0.6 OR (NOT sure AND confidence > 0.5) AS is_transformer FROM b""")
def architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber").cast("long")
    layers = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 300).alias("model"), (F.col("l_quantity").cast("long") * 48).alias("r"), F.when(n == 1, 50000).otherwise(n * 256).cast("long").alias("c"))
    return W.architecture(layers, "model", "r", "c")


_CALLS = ["torch.load", "sklearn.pipeline.Pipeline", "tf.constant", "numpy.array", "print", "x.state_dict()"]
_STACKS = ["torch.nn. torch.", "keras. tf.", "", "np.array numpy.x"]
_VOTE = " ".join(
    f"WHEN v_{name} = greatest({', '.join('v_' + n for n in T.FRAMEWORK_VOTES)}) AND v_{name} > 0 THEN '{name}'" for name in T.FRAMEWORK_VOTES
)
_VOTES = ", ".join(
    "(" + " + ".join(f"2 * regexp_matches(call, {quoted('(?i)' + p)})::INT + len(regexp_extract_all(stack, {quoted('(?i)' + p)})) + 0.5 * len(regexp_extract_all(file, {quoted('(?i)' + p)}))" for p in patterns) + f") AS v_{name}"
    for name, patterns in T.FRAMEWORK_VOTES.items()
)


@_add(f"""WITH s AS (SELECT doc_id, ([{', '.join(map(quoted, _CALLS))}])[(doc_id % 6 + 1)::INT] AS call, ([{', '.join(map(quoted, _STACKS))}])[(doc_id % 4 + 1)::INT] AS stack, CASE doc_id % 5 WHEN 0 THEN 'm/saved_model.pb' ELSE '' END AS file FROM documents),
v AS (SELECT doc_id, {_VOTES} FROM s) SELECT doc_id, CASE {_VOTE} ELSE 'unknown' END AS framework FROM v""")
def framework_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("doc_id") % n + 1).cast("int"))
    file = F.when(F.col("doc_id") % 5 == 0, "m/saved_model.pb").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", W.framework_vote(pick(_CALLS, 6), pick(_STACKS, 4), file).alias("framework"))


@_add("""SELECT doc_id, n_chars, total_before FROM (SELECT doc_id, n_chars, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS total_before FROM documents) WHERE total_before <= 1000000""")
def running_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.running_limit(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 1_000_000)


@_add("""WITH o AS (SELECT user_id, value, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, round(sum(value * CASE WHEN n = 1 THEN pow(0.9, k - 1) ELSE 0.1 * pow(0.9, k - n) END), 6) AS mean FROM o GROUP BY user_id""")
def decayed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.decayed_mean(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("mean", F.round("mean", 6))


_SIGNALS = {k: f"CASE WHEN doc_id % {m} = 0 THEN NULL ELSE (doc_id * {i + 3} % 11) / 10.0 END" for i, (k, m) in enumerate(zip(W.SIGNALS, (7, 3, 4, 5, 9, 2), strict=True))}
_UP = " + ".join(f"coalesce({c}, 0) * {W.SIGNALS[k]}" for k, c in _SIGNALS.items())
_DOWN = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {W.SIGNALS[k]} END" for k, c in _SIGNALS.items())


@_add(f"""WITH s AS (SELECT doc_id, round(({_UP}) / nullif({_DOWN}, 0), 6)::DOUBLE AS score, {_SIGNALS['semantic_analysis']} AS sem, {_SIGNALS['anomaly_detection']} AS ano FROM documents),
r AS (SELECT *, greatest(1 - score, CASE WHEN sem < 0.3 THEN 0.7 ELSE 0 END::DOUBLE, CASE WHEN ano < 0.3 THEN 0.6 ELSE 0 END::DOUBLE) AS risk FROM s)
SELECT doc_id, score::DOUBLE AS score, score > 0.5 AS is_suspicious, CASE WHEN risk < 0.2 THEN 'safe' WHEN risk < 0.4 THEN 'low' WHEN risk < 0.6 THEN 'medium' WHEN risk < 0.8 THEN 'high' ELSE 'critical' END AS level FROM r""")
def weighted_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    signals = {k: F.when(i % m != 0, (i * (n + 3) % 11) / 10.0) for n, (k, m) in enumerate(zip(W.SIGNALS, (7, 3, 4, 5, 9, 2), strict=True))}
    out = table(spark, sf_dir, "documents").select("doc_id", F.round(W.weighted_signals(signals, W.SIGNALS), 6).alias("score"), signals["semantic_analysis"].alias("sem"), signals["anomaly_detection"].alias("ano"))
    risk = W.risk_level(F.col("score"), F.col("sem"), F.col("ano"))
    return out.select("doc_id", "score", (F.col("score") > 0.5).alias("is_suspicious"), risk.alias("level"))


@_add("""SELECT doc_id, round(least((0.2 * (doc_id % 4) + 0.1 * (doc_id % 5)) * CASE WHEN doc_id % 2 = 0 THEN 0.7 ELSE 1 END * CASE WHEN doc_id % 3 = 0 THEN 0.8 ELSE 1 END * CASE WHEN lang = 'en' THEN 0.9 ELSE 1 END, 1), 6)::DOUBLE AS risk FROM documents""")
def context_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    risk = W.context_risk(F.array(0.2 * (i % 4), 0.1 * (i % 5)), i % 2 == 0, i % 3 == 0, F.when(F.col("lang") == "en", "keras").otherwise("other"))
    return _rounded(table(spark, sf_dir, "documents").select("doc_id", risk.alias("risk")))
