"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of text in that
language. A text is compressed whole with each dictionary, and the language of
the smallest result is chosen. The margin, by how much the next language needs
more, tells how sure that is; a text with a narrow margin is flagged as
rejected, and its score is low.

Training text is a bounded sample, the ``SAMPLE`` distinct texts of a language
with the least hash, or all if there are fewer, however many copies they have,
so it is the same whatever the partitioning. The dictionary has at most
``DICTIONARY`` bytes, of which each sampled text gets an equal share, from its
beginning (with 400 texts about 290 bytes each; what short texts leave goes to
the longer ones, up to ``READ`` shares). Every other row is only scored, whole, in one narrow Arrow
pass; nothing is shuffled but the sample and the distinct hashes of training
texts. The model grows with the number of languages, not of rows; more than
``MAX_LANGUAGES`` are refused by an error.

Text is compressed in lower case with everything between letters as one space.
A long text is compressed in frames of ``FRAME`` bytes, each with the
dictionary, so that every part of it is held against the languages.

Defined results. Null text or no letter (Unicode category L): ``und``, score 0. No training rows at
all: ``und``. Ties go to the language with more training rows, then to the
first in the alphabet. Repeated
rows and equal texts get equal results; an empty table gives an empty result.
Extra columns are not looked at; a column in ``keep`` that is named like an
output gets underscores before its name.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept, table
from .textvec import blocks

SAMPLE = 400
MAX_LANGUAGES = 1000
DICTIONARY = 112 << 10
READ = 4  # characters read of a sampled text, as a multiple of its equal share; bounds what comes to the driver
FRAME = 2 << 10
LEVEL = 5
MARGIN = 0.01  # of the smallest size; narrower is rejected
BLOCK_BYTES = 4 << 20
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """What is compressed: lower case, everything between letters as one space."""
    return _OTHER.sub(" ", text.lower())


def has_letter(text: str | None) -> bool:
    """Whether there is a sign of Unicode category L."""
    return any(map(str.isalpha, text or ""))


def shares(texts: list[bytes], size: int) -> bytes:
    """The beginnings of the texts, as equally long as their lengths allow, ``size`` bytes together."""
    left, parts = size, {}
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        parts[i] = texts[i][: max(0, left // (len(texts) - done) - 1)]
        left -= len(parts[i]) + 1
    return b" ".join(parts[i] for i in range(len(texts)))


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_text(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE, size: int = DICTIONARY) -> dict[str, bytes]:
    """Per language, from the most frequent on, the text of its dictionary."""
    rows = docs.select(F.col(lang).alias("lang"), F.xxhash64(text).alias("order"), F.substring(F.col(text), 1, max(256, READ * size // sample)).alias("text"))
    rows = rows.where("lang is not null and lang <> 'und' and length(text) > 0")
    many = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(many) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    # the least distinct hashes, at most ``sample`` a language and task before the shuffle; then their texts, with no text sorted but these
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    best = rows.groupBy("lang", "order").agg(F.lit(1).alias("one")).withColumn("n", place).where(F.col("n") <= sample)
    best = F.broadcast(best.select(F.col("lang").alias("of"), F.col("order").alias("least")))  # sample * MAX_LANGUAGES rows at most
    few = rows.join(best, (F.col("lang") == F.col("of")) & (F.col("order") == F.col("least"))).groupBy("lang", "order").agg(F.min("text").alias("text"))
    size_of = {r.lang: r.n for r in many}
    found: dict[tuple[int, str], list[tuple[int, str]]] = {}
    for r in few.toLocalIterator():
        found.setdefault((-size_of[r.lang], r.lang), []).append((r.order, r.text))
    return {lang: shares([letters(t).encode() for _, t in sorted(texts)], size) for (_, lang), texts in sorted(found.items())}


class Compressors:
    def __init__(self, texts: dict[str, bytes]):
        self.languages = list(texts)
        self.compress = []
        for lang in self.languages:
            known = zstandard.ZstdCompressionDict(texts[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compress.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False).compress)

    def sizes(self, text: bytes) -> list[int]:
        frames = [text[i : i + FRAME] for i in range(0, len(text), FRAME)]
        return [sum(len(c(f)) for f in frames) for c in self.compress]


_OUT = ["lang_pred", "score", "rejected"]


def identify(docs: DataFrame, texts: dict[str, bytes], keep: list[str], text: str = "text", margin: float = MARGIN) -> DataFrame:
    """The columns ``keep`` with lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(texts)
    names = [f"c{i}" for i in range(len(keep))]

    def run(batches):
        made = Compressors(shared.value)
        for block in blocks(batches, BLOCK_BYTES):
            langs, scores, rejected = [], [], []
            for value in block.column(0).to_pylist():
                if not made.languages or not has_letter(value):
                    langs.append("und"), scores.append(0.0), rejected.append(True)
                    continue
                sizes = made.sizes(letters(value).encode())
                best = int(np.argmin(sizes))
                gap = (min([*sizes[:best], *sizes[best + 1 :]], default=2 * sizes[best]) - sizes[best]) / sizes[best]
                langs.append(made.languages[best])
                scores.append(gap / (gap + margin))
                rejected.append(gap < margin)
            yield pa.RecordBatch.from_arrays([*block.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*names, *_OUT])

    renamed = docs.select(F.col(text).alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    schema = ", ".join(f"{n} {renamed.schema[n].dataType.simpleString()}" for n in names)
    return renamed.mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean").toDF(*kept(keep, _OUT), *_OUT)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    texts = training_text(docs.where(~F.col("held_out")))
    return identify(docs.drop("lang"), texts, ["doc_id", "held_out"])
