"""Column functions for one log line (X1-X7): all JVM-side, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_timestamp(raw: Column | str) -> Column:
    """Remove one leading ISO / wall-clock / human-date timestamp."""
    return F.regexp_replace(_c(raw), P.J(P.TIMESTAMP_PREFIX), "")


def cap_line(text: Column | str, max_chars: int | None = None) -> Column:
    """Optional per-line cap with a ``<truncated>`` marker; without ``max_chars`` the whole line."""
    t = _c(text)
    if max_chars is None:
        return t
    return F.when(F.length(t) > max_chars, F.concat(F.substring(t, 1, max_chars), F.lit(P.TRUNCATED_SUFFIX))).otherwise(t)


def indent_width(stripped: Column | str) -> Column:
    """Count of leading spaces and tabs."""
    return F.length(F.regexp_extract(_c(stripped), r"^[ \t]*", 0))


def display_text(stripped: Column | str) -> Column:
    """ANSI codes removed, horizontal whitespace runs collapsed, trimmed."""
    out = F.regexp_replace(_c(stripped), P.ANSI, "")
    out = F.regexp_replace(out, P.J(r"\s+"), " ")
    return F.trim(out)


def classify_kind(indented: Column | str, template: Column | str) -> Column:
    """Shape of the line; stacks on the indented text, the rest on the template."""
    ind, tpl = _c(indented), _c(template)
    return (
        F.when(tpl == "", F.lit(P.KIND_PLAIN))
        .when(tpl.rlike(P.J(P.BANNER)), F.lit(P.KIND_BANNER))
        .when(ind.rlike(P.J(P.STACK_ANY)), F.lit(P.KIND_STACK))
        .when(tpl.rlike(P.J(P.PROGRESS)), F.lit(P.KIND_PROGRESS))
        .when(tpl.rlike(P.J(P.JSON_OPEN)), F.lit(P.KIND_JSON))
        .when(tpl.rlike(P.J(P.CMD)), F.lit(P.KIND_CMD))
        .when(tpl.rlike(P.J(P.KV)), F.lit(P.KIND_KV))
        .otherwise(F.lit(P.KIND_PLAIN))
    ).cast("tinyint")


def classify_severity(display: Column | str) -> Column:
    """First matching rule wins; CAUSE and EXIT share level 5."""
    d = _c(display)
    return (
        F.when(d.rlike(P.J(P.SEV_CAUSE)), F.lit(P.SEV_EXIT))
        .when(d.rlike(P.J(P.SEV_EXIT_RX)), F.lit(P.SEV_EXIT))
        .when(d.rlike(P.J(P.SEV_FATAL_RX)), F.lit(P.SEV_FATAL))
        .when(d.rlike(P.J(P.SEV_ERROR_RX)), F.lit(P.SEV_ERROR))
        .when(d.rlike(P.J(P.SEV_WARN_RX)), F.lit(P.SEV_WARN))
        .otherwise(F.lit(P.SEV_INFO))
    ).cast("tinyint")


def approx_tokens(text: Column | str, note: Column | str | None = None) -> Column:
    """Token cost of a rendered line: ``max(1, (len(text)+len(note)+6) // 4)``."""
    n = F.length(_c(text))
    if note is not None:
        n = n + F.coalesce(F.length(_c(note)), F.lit(0))
    return F.greatest(F.lit(1), F.floor((n + 6) / 4).cast("int"))
