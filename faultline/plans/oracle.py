"""SQL text for the DuckDB oracle: the line tokenizer written as plain SQL.

DuckDB uses RE2, which has no look-behind; the unix-path mask is therefore written
with a captured leading character (``(^|[^\\w/-])``) and put back by ``\\1``.
"""

from __future__ import annotations

from ..functions import patterns as P

PATH_UNIX_RE2 = r"(^|[^\w/-])/[\w./@\-]+"
PATH_UNIX_RE2_EXTRACT = r"(^|[^\w/-])(/[\w./@\-]+)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def tokenized_sql(src: str, keys: str = "log_id, idx", name: str = "lines") -> str:
    """CTE ``name`` with (keys, raw, text, template, var_tokens, kind, severity, indent)."""
    # Materialise each mask step as its own column to keep the SQL small.
    steps = []
    prev = "text"
    for i, (rx, label) in enumerate(P.MASKERS):
        if rx == P.PATH_UNIX:
            tok = f"regexp_extract_all({prev}, {q(PATH_UNIX_RE2_EXTRACT)}, 2)"
            nxt = f"regexp_replace({prev}, {q(PATH_UNIX_RE2)}, {q(chr(92) + '1' + label)}, 'g')"
        else:
            tok = f"regexp_extract_all({prev}, {q(rx)}, 0)"
            nxt = f"regexp_replace({prev}, {q(rx)}, {q(label)}, 'g')"
        steps.append((f"_t{i}", tok, f"_m{i}", nxt))
        prev = f"_m{i}"
    kind = (
        "CASE WHEN text = '' THEN 0 "
        f"WHEN regexp_matches(template, {q(P.BANNER)}) THEN 6 "
        f"WHEN regexp_matches(stripped, {q(P.STACK_ANY)}) THEN 4 "
        f"WHEN regexp_matches(template, {q(P.PROGRESS)}) THEN 5 "
        f"WHEN regexp_matches(template, {q(P.JSON_OPEN)}) THEN 3 "
        f"WHEN regexp_matches(template, {q(P.CMD)}) THEN 1 "
        f"WHEN regexp_matches(template, {q(P.KV)}) THEN 2 ELSE 0 END"
    )
    sev = (
        "CASE WHEN text = '' THEN 0 "
        f"WHEN regexp_matches(text, {q(P.SEV_CAUSE)}) THEN 5 "
        f"WHEN regexp_matches(text, {q(P.SEV_EXIT_RX)}) THEN 5 "
        f"WHEN regexp_matches(text, {q(P.SEV_FATAL_RX)}) THEN 4 "
        f"WHEN regexp_matches(text, {q(P.SEV_ERROR_RX)}) THEN 3 "
        f"WHEN regexp_matches(text, {q(P.SEV_WARN_RX)}) THEN 1 ELSE 0 END"
    )
    parts = [
        f"{name}_s0 AS (SELECT {keys}, raw, s AS stripped "
        f"FROM (SELECT {keys}, raw, regexp_replace(raw, {q(P.TIMESTAMP_PREFIX)}, '') AS s FROM {src}))",
        f"{name}_s1 AS (SELECT *, trim(regexp_replace(regexp_replace(stripped, {q(P.ANSI)}, '', 'g'), '\\s+', ' ', 'g')) AS text FROM {name}_s0)",
    ]
    prev_cte = f"{name}_s1"
    for i, (tname, tok, mname, nxt) in enumerate(steps):
        cte = f"{name}_m{i}"
        parts.append(f"{cte} AS (SELECT *, {tok} AS {tname}, {nxt} AS {mname} FROM {prev_cte})")
        prev_cte = cte
    toks = ", ".join(f"_t{i}" for i in range(len(steps)))
    last = f"_m{len(steps) - 1}"
    parts.append(
        f"{name}_t AS (SELECT {keys}, raw, stripped, text, {last} AS template, "
        f"flatten([{toks}]) AS var_tokens, "
        f"CASE WHEN text = '' THEN 0 ELSE length(regexp_extract(stripped, '^[ \\t]*', 0)) END AS indent FROM {prev_cte})"
    )
    parts.append(
        f"{name} AS (SELECT {keys}, raw, text, template, var_tokens, CAST({kind} AS TINYINT) AS kind, "
        f"CAST({sev} AS TINYINT) AS severity, CAST(indent AS INTEGER) AS indent FROM {name}_t)"
    )
    return ",\n".join(parts)
