"""Regular expressions and word lists the results depend on.

Fixed values: the classification rules, masks and hint lists below must equal the
behaviour being reproduced, so they are kept verbatim, in their natural order and
together in this one module. Everything else in the package derives from them.

Spark evaluates them with Java regex. ``J()`` adds ``(?U)`` so that ``\\w``, ``\\d``
and ``\\b`` follow Unicode rules as Python's ``re`` does for ``str`` patterns.
"""

from __future__ import annotations


def J(pattern: str) -> str:
    """Java regex with Unicode character classes (Python ``re`` semantics)."""
    return "(?U)" + pattern


# ── Fixed values: line normalisation ─────────────────────────────────────────
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
TIMESTAMP_PREFIX = (
    r"^(?:"
    r"\[?\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?\]?\s*"
    r"|"
    r"\d{2}:\d{2}:\d{2}(?:\.\d+)?\s+"
    r"|"
    r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    r"\s+\d{1,2},?\s+\d{4}\s+\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM)?\s*"
    r")"
)
TRUNCATED_SUFFIX = " <truncated>"

# Masks, applied in this order; each (pattern, label).
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
URL = r"https?://\S+"
PATH_UNIX = r"(?<![\w/-])/[\w./@\-]+"
PATH_WIN = r"\b[A-Z]:\\[\w.\\@\-]+"
HEX = r"\b[0-9a-f]{8,}\b"
SIZE = r"(?i)\b\d+(?:\.\d+)?\s?(?:[KMGT]i?B|ms|µs|us|s|min)\b"
NUMS = r"\b\d{2,}\b"
MASKERS = (
    (UUID, "UUID"),
    (URL, "URL"),
    (PATH_UNIX, "PATH"),
    (PATH_WIN, "PATH"),
    (HEX, "HEX"),
    (SIZE, "SIZE"),
    (NUMS, "N"),
)
MASK_LABELS = ("PATH", "URL", "UUID", "HEX", "SIZE", "N")

# ── Fixed values: line kind (shape) ──────────────────────────────────────────
KIND_PLAIN, KIND_CMD, KIND_KV, KIND_JSON, KIND_STACK, KIND_PROGRESS, KIND_BANNER = range(7)
KIND_NAMES = ("PLAIN", "CMD", "KV", "JSON", "STACK", "PROGRESS", "BANNER")

BANNER = r"^[\s\-=*#~_]{8,}$|^\s*::\s*Spring Boot\s*::|^\s*\(v\d+\.\d+\.\d+\)\s*$"
STACK_JAVA = r"^\s+at\s+[\w$./<>]+\([^)]*\)"
STACK_PY = r'^\s+File ".+", line \d+'
STACK_GO = r"^\s+\S+\.go:\d+(?:\s+\+0x[0-9a-f]+)?\s*$"
STACK_RUST = r"^\s+\d+:\s+0x[0-9a-f]+"
STACK_NODE = r"^\s+at\s+(?:async\s+)?\S+\s+\([^)]+\)"
STACK_ELLIPSIS = r"^\s*\.{3}\s+\d+\s+more\s*$"
STACK_ANY = "|".join(
    f"(?:{p})" for p in (STACK_JAVA, STACK_PY, STACK_GO, STACK_RUST, STACK_NODE, STACK_ELLIPSIS)
)
PROGRESS = (
    r"(?i)\d+%\s|"
    r"\[[=\->\s\d]*[=>]\s*\d*\s*\]|"
    r"\b\d+/\d+\s+(?:packages|tests|files|chunks|steps)\b|"
    r"\b(?:Downloading|Extracting|Pulling|Pushing|Uploading|"
    r"Pull complete|Layer already exists|Already exists|"
    r"Verifying|Status:|Digest:)\b"
)
CMD = r"^\s*[+$]\s+\S"
KV = r"^\s*[A-Za-z_][\w.\-]{1,60}\s*[:=]\s*\S"
JSON_OPEN = r'^\s*[{\[](?:\s*["\d-]|\s*$)'

# ── Fixed values: severity (first matching rule wins) ────────────────────────
SEV_INFO, SEV_WARN, SEV_ERROR, SEV_FATAL, SEV_EXIT = 0, 1, 3, 4, 5
SEV_CAUSE = r"(?i)(?:^|\s)Caused\s+by:\s*\S"
SEV_EXIT_RX = (
    r"(?i)(?:exit|return)\s*(?:code|status)?\s*[:=]?\s*[1-9]\d*\b|"
    r"script\s+returned\s+exit\s+code\s*[1-9]|"
    r"process\s+exited\s+with\s+(?:code\s+)?[1-9]|"
    r"\bnon-zero\s+exit\b"
)
SEV_FATAL_RX = r"(?i)\bFATAL\b|\bSEVERE\b|\bpanic(?:ked)?\b|\bsegmentation\s+fault\b|\bcore\s+dumped\b"
SEV_ERROR_RX = (
    r"(?i)\bERROR\b|^\s*Error:\s|\[ERROR\]|"
    r"\berror\[[A-Z0-9]+\]|"
    r"\bnpm\s+ERR!|"
    r"\b[A-Z]\w+(?:Exception|Error|Failure|Fault)\b"
)
SEV_WARN_RX = r"(?i)\bWARN(?:ING)?\b|\[WARN\]"
SEVERITY_WEIGHT = {0: 0, 1: 1, 3: 3, 4: 4, 5: 5}

# ── Fixed values: structural collapse ────────────────────────────────────────
# Directory / package hints marking a stack frame as framework code (collapser list).
PKG_MGR_HINTS = (
    "/site-packages/",
    "/node_modules/",
    "/.m2/",
    "/.gradle/",
    "/.cargo/",
    "/usr/lib/",
    "/usr/local/",
    "/opt/",
    "vendor/",
    "/gems/",
    "java.base/",
    "java.lang.",
    "sun.nio.",
    "sun.reflect.",
    "jdk.internal.",
)
STACK_KEEP_PROJECT = 3
JSON_KEY = r'^\s*"([^"]{1,60})"\s*:'
JSON_MIN_RUN = 5
PROGRESS_MIN_RUN = 4
REPEAT_WINDOW = 50
REPEAT_MIN_COUNT = 3
COLLAPSE_REASONS = ("banner", "stack-frame-elided", "json-folded", "progress-elided", "repeat-elided")

# ── Fixed values: baseline, scoring and selection ────────────────────────────
SELF_BASELINE_PREFIX = 0.30
SELF_BASELINE_MIN_LINES = 20
SELF_BASELINE_MIN_COUNT = 3
SKETCH_COMMON = 0.6
SKETCH_VERY_COMMON = 0.9
MIN_ANCHOR_SCORE = 3
CONTEXT_BEFORE = 2
CONTEXT_AFTER = 4
CLUSTER_MERGE_GAP = 3
BODY_MAX_TOKENS = 1500
