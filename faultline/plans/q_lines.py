"""Pass 1 queries: splitting, masking, classification, per-log template counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tokenize as T
from ..sources import adapters as A
from ..sources.tables import read_table
from .catalog import register
from .oracle import tokenized_sql

_LINES = A.ADAPTER_SQL["log_lines"].strip() + ",\n" + tokenized_sql("log_lines")


def annotated_lines(spark, sf_dir):
    """Adapter log lines with every Pass-1 annotation."""
    return T.annotate(A.log_lines(spark, sf_dir))


@register("s1_split_lines", oracle=r"""
WITH d AS (
  SELECT doc_id, regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\x{FEFF}+', '') AS t
  FROM documents WHERE length(text) > 0
), l AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE line = '') AS BIGINT) AS n_blank,
       CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM l GROUP BY doc_id
""")
def s1_split_lines(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = T.split_lines(docs, raw_col="text", key_cols=("doc_id",))
    return lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.col("raw") == "", 1)).alias("n_blank"),
        F.sum(F.length("raw")).cast("bigint").alias("n_chars"),
    )


@register("x3_template_mask", oracle=f"""
WITH {_LINES}
SELECT log_id, idx, text, template, array_to_string(var_tokens, '|') AS var_tokens, indent FROM lines
""")
def x3_template_mask(spark, sf_dir):
    df = annotated_lines(spark, sf_dir)
    return df.select("log_id", "idx", "text", "template", F.array_join("var_tokens", "|").alias("var_tokens"), "indent")


@register("x5_line_classify", oracle=f"""
WITH {_LINES}
SELECT template, CAST(severity AS INTEGER) AS severity, CAST(kind AS INTEGER) AS kind, CAST(count(*) AS BIGINT) AS n_lines
FROM lines GROUP BY template, severity, kind
""")
def x5_line_classify(spark, sf_dir):
    df = annotated_lines(spark, sf_dir)
    return df.groupBy("template", F.col("severity").cast("int").alias("severity"), F.col("kind").cast("int").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_lines"))


@register("x6_severity_by_log", oracle=f"""
WITH {_LINES}
SELECT log_id, CAST(severity AS INTEGER) AS severity, CAST(count(*) AS BIGINT) AS n_lines, min(idx) AS first_idx
FROM lines GROUP BY log_id, severity
""")
def x6_severity_by_log(spark, sf_dir):
    df = annotated_lines(spark, sf_dir)
    return df.groupBy("log_id", F.col("severity").cast("int").alias("severity")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.min("idx").alias("first_idx"))


@register("a9_template_counts", oracle=f"""
WITH {_LINES}
SELECT log_id, idx, CAST(CASE WHEN text <> '' THEN count(*) OVER (PARTITION BY log_id, template) ELSE 0 END AS BIGINT) AS template_count
FROM lines
""")
def a9_template_counts(spark, sf_dir):
    df = T.template_counts(annotated_lines(spark, sf_dir))
    return df.select("log_id", "idx", F.col("template_count").cast("bigint").alias("template_count"))
