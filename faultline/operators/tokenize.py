"""Pass 1: raw logs to annotated lines.

One row per line. ``split_lines`` turns whole logs into rows; ``annotate`` adds
``text`` (display form), ``template`` (masked form), ``var_tokens``, ``kind``,
``severity`` and ``indent``. Each mask step is its own projection so the regex
chain is evaluated once per line (Catalyst will not inline a non-cheap alias that
is referenced twice).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import patterns as P


def split_lines(logs: DataFrame, raw_col: str = "raw", key_cols: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """CRLF/CR to LF, leading BOM removed, split on LF keeping blanks.

    Empty logs produce no lines. Output: key columns, ``idx`` (0-based), ``raw``.
    """
    norm = F.regexp_replace(F.regexp_replace(F.col(raw_col), "\r\n", "\n"), "\r", "\n")
    norm = F.regexp_replace(norm, r"^\x{FEFF}+", "")
    return (
        logs.filter(F.length(F.col(raw_col)) > 0)
        .select(*key_cols, F.posexplode(F.split(norm, "\n", -1)).alias("idx", "raw"))
        .withColumn("idx", F.col("idx").cast("int"))
    )


def annotate(lines: DataFrame, raw_col: str = "raw", max_line_chars: int | None = None) -> DataFrame:
    """X1-X7 on every line; blank lines become PLAIN/INFO with empty template. Lines are whole unless a cap is given."""
    df = lines.withColumn("_stripped", L.cap_line(L.strip_timestamp(raw_col), max_line_chars))
    df = df.withColumn("indent", L.indent_width("_stripped").cast("int"))
    df = df.withColumn("text", L.display_text("_stripped"))
    # Mask chain: every step captures the values it replaced, in mask order.
    cur = "text"
    toks = []
    for i, (rx, label) in enumerate(P.MASKERS):
        nxt = f"_m{i}"
        df = df.withColumn(f"_t{i}", F.regexp_extract_all(F.col(cur), F.lit(P.J(rx)), 0))
        df = df.withColumn(nxt, F.regexp_replace(F.col(cur), P.J(rx), label))
        toks.append(F.col(f"_t{i}"))
        cur = nxt
    df = df.withColumn("template", F.col(cur)).withColumn("var_tokens", F.concat(*toks))
    blank = F.col("text") == ""
    df = (
        df.withColumn("kind", F.when(blank, F.lit(0).cast("tinyint")).otherwise(L.classify_kind("_stripped", "template")))
        .withColumn("severity", F.when(blank, F.lit(0).cast("tinyint")).otherwise(L.classify_severity("text")))
        .withColumn("indent", F.when(blank, F.lit(0)).otherwise(F.col("indent")))
    )
    drop_cols = ["_stripped"] + [f"_t{i}" for i in range(len(P.MASKERS))] + [f"_m{i}" for i in range(len(P.MASKERS))]
    return df.drop(*drop_cols)


def tokenize(logs: DataFrame, raw_col: str = "raw", key_cols: tuple[str, ...] = ("log_id",)) -> DataFrame:
    """S1 + annotate: whole logs to annotated line rows."""
    return annotate(split_lines(logs, raw_col, key_cols))


def template_counts(lines: DataFrame, key: str = "log_id") -> DataFrame:
    """Occurrences of each template within its log, as a column on every line."""
    w = Window.partitionBy(key, "template")
    return lines.withColumn("template_count", F.when(F.col("text") != "", F.count(F.lit(1)).over(w)).otherwise(F.lit(0)))
