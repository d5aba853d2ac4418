"""The rule catalogue as a dimension table.

The catalogue is a parameter: ``read_catalogue`` loads any number of rules from
JSON lines. Built in is the whole rule table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import RULES

SCHEMA = "ordinal int, code string, severity string, patterns array<string>"

#: code, default severity, message patterns (they ignore case); the order is the priority.
BUILT_IN = [(code, severity, patterns) for code, severity, _, patterns in RULES]


def built_in(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(BUILT_IN)], SCHEMA)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines with the columns of SCHEMA."""
    return spark.read.schema(SCHEMA).json(path)


def match_rules(messages: DataFrame, rules: DataFrame, message: str = "message") -> DataFrame:
    """``messages`` with rule_code: the first rule in order of which a pattern is found; null if none is.

    Messages repeat, so distinct ones are matched and joined back. The rules
    come to the driver and become expressions, MAX_RULES in each, whose patterns
    Spark compiles once; a catalogue of any size is matched whole.
    """
    found = rules.orderBy("ordinal").collect()
    codes = []
    for at in range(0, len(found), MAX_RULES):
        code = F
        for r in found[at : at + MAX_RULES]:
            hit = F.col("of_message").rlike("(?i)" + "|".join(f"(?:{p})" for p in r.patterns))
            code = code.when(hit, F.lit(r.code))
        codes.append(code)
    distinct = messages.select(F.col(message).alias("of_message")).where("of_message is not null").distinct()
    distinct = distinct.withColumn("rule_code", F.coalesce(*codes) if codes else F.lit(None).cast("string"))
    return messages.join(distinct, F.col(message) == F.col("of_message"), "left").drop("of_message")


MAX_RULES = 200
