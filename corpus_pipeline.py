"""Training-corpus pipeline: five stages over ``documents``, each an operator of ``faultline.llm``.

Every stage takes ``(spark, docs, sf_dir)``, works on all that its predecessor kept, and its
result is written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``:

1. quality rules: documents that the base rule or their group's thresholds reject go;
2. near duplicates (five-word shingles, similarity 0.8): of each group the document with the smallest id stays;
3. decontamination: documents that the benchmark contaminates go;
4. secret scan: every finding is masked in the text, ``n_chars`` follows;
5. SentencePiece: (doc_id, lang, source, n_chars, ids, n_tokens, round_trip), ``round_trip``
   tells whether the ids decode to the text.

The stages handle null, empty and very long texts, repeated rows and empty tables as
their operators' docstrings say; further columns of ``docs`` pass through the first four.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.llm import decontaminate, minhash, quality, secret_scan, sentencepieces  # noqa: E402
from faultline.llm.common import written  # noqa: E402
from faultline.llm.queries import piece_model  # noqa: E402
from faultline.session import ship_package  # noqa: E402
from faultline.sources.tables import read_table  # noqa: E402

#: The shares of words, the network and the backtracking have no compact SQL: tests use brute force.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return secret_scan.redact(docs, secret_scan.fit(docs), length_col="n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    coded = sentencepieces.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), piece_model(),
                                  decoded_col="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return coded.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("bigint").alias("n_tokens"),
                        same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("sentencepiece", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
