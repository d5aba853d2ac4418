"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
each stage's rows to the shared folder as Parquet and reads them again as the
next one's docs, so a lost executor costs no finished stage.

Each stage's intermediate tables, and the rows of the stage before, are deleted
as soon as its own rows are written.

Defined results. A null text passes the near-duplicate and passage stages
unchanged; the quality rules reject it, since it has no words; an empty text
likewise. Repeated rows are copies of one another: the least doc_id stays, and of
rows that repeat it one. Very long texts are taken whole. An empty table of
documents gives no pieces; an empty benchmark rejects nothing. Extra columns of
documents pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluicework.llm.decontamination import remove_contaminated
from sluicework.llm.ngram_join import keep_one
from sluicework.llm.packing import TOKENIZER, pack
from sluicework.llm.quality_rules import quality_filter
from sluicework.llm.shared import discard, scratch, table, write
from sluicework.llm.substring_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without boilerplate lines."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of repeated passages."""
    return remove_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence, with their token ids."""
    return pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", passages),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]

#: SQL has neither the tokenizer nor the sketches; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            path = write(out, lasting=True)
        if before:
            discard(spark, before)
        docs, before = spark.read.schema(out.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
