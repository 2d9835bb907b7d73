"""Registered queries of the training-data operators and their DuckDB oracles.

Each query is thin: it applies one operator to its whole table and derives the
contract's digest columns from the operator's own output.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table
from . import (automaton, decontaminate, minhash, ngrams, preferences, quality, repair, runs, secret_scan, sentencepieces, suffixarray,
               warc, wrappers)
from .common import WHITE_RE, hex_sha256
from .oracles import ORACLES  # noqa: F401 - read by the entry point

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        return run
    return deco


@register("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    index = decontaminate.build_index(docs)
    matches = decontaminate.search(index, read_table(spark, sf_dir, "benchmark", ["item_id", "text"]))
    found = decontaminate.contamination(index, matches)
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        hex_sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


@register("op2_substring_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = automaton.substring_dedup(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_words"), F.col("removed").alias("n_removed"),
                        hex_sha256("kept").alias("kept_sha256"))


@register("op3_suffix_array_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = suffixarray.suffix_dedup(docs)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_bytes"), F.col("removed").alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), hex_sha256("kept").alias("kept_sha256"))


def piece_model() -> str:
    """The public 32k-piece BPE model (its path is the operator's parameter)."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@register("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    coded = sentencepieces.encode(docs, piece_model(), decoded_col="decoded")
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), hex_sha256(ids).alias("ids_sha256"),
                        hex_sha256("decoded").alias("decoded_sha256"))


@register("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    measured, limits, q = quality.fit(docs, keep=("doc_id",))
    judged = quality.judge(measured, limits, q)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *[F.col(q)[c].alias(c) for c in names])


@register("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = secret_scan.scan(docs, secret_scan.fit(docs)).drop("text")
    base = secret_scan.KINDS[:3]
    counts = [secret_scan.number(F.col("findings"), k).alias(f"n_{k}") for k in base]
    return found.select("doc_id", *counts, hex_sha256(secret_scan.joined(F.col("findings"), base)).alias("base_sha256"),
                        secret_scan.joined(F.col("findings")).alias("spans"))


@register("op8_minhash_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    found = minhash.near_duplicates(docs, n_words=4, percent=80)
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "component_id",
                        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


@register("op9_preference_formatting")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is chosen against itself with the last reply of the next one that has a reply."""
    turns = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    made = preferences.format_pairs(preferences.replaced_replies(preferences.conversations(turns)))

    def spans(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")

    return made.select("conv_id", F.col("n_prompt_turns").cast("bigint").alias("n_prompt_turns"),
                       hex_sha256("prompt").alias("prompt_sha256"),
                       hex_sha256("chosen_completion").alias("chosen_sha256"), spans("chosen_spans").alias("chosen_spans"),
                       hex_sha256("rejected_completion").alias("rejected_sha256"), spans("rejected_spans").alias("rejected_spans"))


@register("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return wrappers.extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@register("op5_warc")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    histories = warc.capture_histories(warc.read_archives(spark, warc.archive(pages)))
    return histories.select(F.col("id").cast("bigint").alias("page_id"), F.col("bytes").alias("payload_bytes"),
                            F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
                            F.col("refers_to").cast("bigint").alias("refers_to"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the contract's periods set into the texts whose id's checksum is a multiple of ten."""
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"),
                       F.when(h % 10 == 0, F.filter(F.split("text", WHITE_RE), lambda w: w != "")).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    made = F.transform("words", lambda w, i: F.when(i >= F.col("a"), F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
                       .otherwise(w))
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


@register("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.find_runs(planted_periods(read_table(spark, sf_dir, "documents", ["doc_id", "text"])))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    found = found.withColumn("best", best)
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.p")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), start.alias("start"),
                        length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("bigint").alias("exponent_milli"),
                        hex_sha256(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")).alias("runs_sha256"),
                        hex_sha256("collapsed").alias("collapsed_sha256"))


@register("op12_lm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null id counts as an empty text (held out); scores have six decimals."""
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 != 0
    found = ngrams.score_texts(docs, train)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"))


def damaged_turns(turns: DataFrame) -> DataFrame:
    """``conversations`` after the contract's damage; rows that it drops stay with ``present`` false."""
    def known(c: str):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                        (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20).alias("k"))
    k = F.col("k")
    rows = rows.select("conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                       (k != 0).alias("present"), F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("col")


@register("op13_structure_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged_turns(read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"]))
    found = repair.repair(turns, present=F.col("present"))
    whole = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return found.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        hex_sha256(whole).alias("repaired_sha256"))
