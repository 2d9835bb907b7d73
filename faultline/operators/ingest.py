"""Ingest: feeds, stages, stage-log excerpts.

CI data arrives as landed tables (feed items, stage rows, flow-node markers, logs)
instead of HTTP calls; every helper is a Column expression or a DataFrame plan.
Per-build folds (the parallel-block marker stack) run over one build's stages and
markers, which a pipeline definition bounds.
"""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import patterns as P

# ── Fixed values ─────────────────────────────────────────────────────────────
FEED_TITLE = r"(.+)\s+#(\d+)\s+\("
FEED_TITLE_BARE = r"(.+)\s+#(\d+)\s*$"
FAILING_STATUSES = ("FAILED", "ERROR", "ABORTED")
HTML_TAG = r"<[^>]+>"
CLOCK_PREFIX = r"(?m)^\d{2}:\d{2}:\d{2}\s+"
TYPED_THROWABLE = r"(?i)\b[A-Z][a-zA-Z0-9_]*(?:Error|Exception)\b"
FAILURE_SIGNAL = (
    r"(?i)(?:"
    r"\b(?:fatal|failure|failures|failed|failing)\b|"
    r"\b(?:exception|exceptions|traceback)\b|"
    r"\bpanic(?:ked)?\b|"
    r"^\s*Error:\s+|"
    r"\b(?:error|err)\b\s*[:!\[\]]|"
    r"\[(?:ERROR|FATAL|CRITICAL)\]|"
    r"\b(?:denied|forbidden|unauthorized|unauthorised)\b|"
    r"(?:^|\s)(?:exit|return)\s*(?:code|status)?\s*[:=]\s*[1-9]\d*|"
    r"script returned exit code\s*[1-9]|"
    r"\bnon-zero\s+exit\b|"
    r"\bFAILED\b|"
    r"\b(?:ECONNREFUSED|ETIMEDOUT|ENOTFOUND|ECONNRESET)\b|"
    r"\b(?:could not|couldn't|unable to)\s+(?:connect|reach|resolve|open|load|find|start|create)\b|"
    r"connection\s+refused|connection\s+reset|broken\s+pipe|"
    r"timed\s+out\s+waiting|"
    r"\bcaused\s+by\s*:\s*\S+|"
    r"\berror\[[A-Z0-9]+\]|"
    r"\bassertion\s+failed\b|internal\s+compiler\s+error|"
    r"\bsegmentation\s+fault\b|\bcore\s+dumped\b|"
    r"\b[A-Z][a-zA-Z0-9_]*(?:Error|Exception)\b"
    r")"
)
BOILERPLATE_ANCHOR = (
    r"(?i)"
    r"re-run\s+maven|for\s+more\s+information\s+about|^\s*---+\s*$|"
    r"cwiki\.apache\.org|\[help\s*1\]|full\s+debug\s+logging|"
    r"^\s*Downloading\s|^\s*Progress\s*\(|Resolving\s+dependencies|"
    r"^\s*\+\+\+\s|"
    r"Request execution error.*endpoint=DefaultEndpoint|"
    r"Request execution failed with message:|"
    r"Cannot execute request on any known server|"
    r"was unable to refresh its cache|"
    r"Initial registry fetch from.*servers failed|"
    r"registration failed Cannot execute|"
    r"ConfigServerConfigDataLoader\s*:|"
    r"Fetching config from server at|"
    r"Exception on Url\s*-\s*http://localhost|"
    r"jakarta\.ws\.rs\.ProcessingException:\s*java\.net\.Connect|"
    r"HttpHostConnectException:\s*Connect to http://localhost|"
    r"TransportException:\s*Cannot execute request|"
    r"ResourceAccessException:.*Connection refused|"
    r"Caused by:\s*java\.net\.ConnectException:\s*Connection refused|"
    r"Caused by:\s*org\.apache\.maven\.plugin\.MojoFailureException|"
    r"LifecycleExecutionException:\s*Failed to execute goal|"
    r"See /var/jenkins_home/.*surefire-reports|"
    r"See dump files \(if any exist\)|"
    r"OptionalValidatorFactoryBean.*no.*provider"
)
OPERATIONAL_HINT = (r"(?i)\b(?:connection|timeout|timed\s+out|socket|dns|network|unreachable|"
                    r"refused|unavailable|not\s+found|no\s+such\s+file|permission\s+denied)\b")
ANCHOR_STRONG_WORD = r"(?i)\b(exception|exceptions|traceback|fatal|panic|failed|failure)\b"
ANCHOR_EXIT = r"(?i)(?:exit|return)\s*(?:code|status)?\s*[:=]\s*[1-9]"
ANCHOR_SCRIPT_EXIT = r"(?i)script returned exit code\s*[1-9]"
ANCHOR_CONN = r"(?i)connection\s+refused|ECONNREFUSED|ENOTFOUND|ETIMEDOUT"
ANCHOR_URL = r"(?i)https?://"
ANCHOR_FRAME = r"(?i)^\s*at\s+[\w$.]+\("
# Leading console timestamps (any number of them) and the noise-line alternation.
TS = r"(?:\[\d{4}-[^\]]+\]\s*|\d{4}-\d{2}-\d{2}T\S+\s+|\d{2}:\d{2}:\d{2}(?:\.\d+)?\s+)*"
NOISE_LINE = (
    r"(?i)^(?:"
    r"^\s*$|"
    rf"^\s*{TS}\[Pipeline\]\s*(?:\{{|\}}|//\s*\w+|$)|"
    rf"^\s*{TS}\[Pipeline\]\s*(?:stage|node|parallel|withEnv|timestamps|timeout|"
    r"getContext|End of Pipeline|tool|envVarsForTool)\b|"
    rf"^\s*{TS}\[INFO\]\s*[-=]{{4,}}\s*$|"
    rf"^\s*{TS}\[INFO\]\s*$|"
    rf"^\s*{TS}\[INFO\]\s*(?:Scanning for projects|"
    r"Building\s|Compiling\s|Copying\s|Installing\s|Deleting\s|Recompiling\s|"
    r"Downloaded\s|Downloading\s|Progress\s|Resolving\s|"
    r"--- \S+:\S+:\S+ .* ---\s*$|"
    r"BUILD SUCCESS|Total time:|Finished at:)|"
    rf"^\s*{TS}\[WARNING\]\s*(?:$|'dependencies|"
    r"Some problems were|It is highly recommended|"
    r"\s*from pom\.xml)|"
    rf"^\s*{TS}(?:Started by|Running in|Timeout set to expire|"
    r"Checking out Revision|using credential|Fetching changes|"
    r"Fetching upstream changes|Commit message:|"
    r"\> git\s|Cloning repository)\b|"
    r".*ConfigServerConfigDataLoader\s*:.*(?:Fetching config|Exception on Url|Connect to .* failed)|"
    r".*Fetching config from server at\s*:|"
    r".*RedirectingEurekaHttpClient\s*:.*Request execution error|"
    r".*RetryableEurekaHttpClient\s*:.*Request execution failed|"
    r".*DiscoveryClient\S*\s.*(?:was unable to refresh|Cannot execute request|"
    r"Initial registry fetch|registration failed|DiscoveryClient_)\b|"
    r".*OptionalValidatorFactoryBean\s*:.*Failed to set up a Bean Validation provider|"
    r".*TransportException:\s*Cannot execute request on any known server|"
    r".*jakarta\.ws\.rs\.ProcessingException:\s*java\.net\.ConnectException|"
    r".*HttpHostConnectException:\s*Connect to http://localhost:\d+\s+failed|"
    r".*ResourceAccessException:.*Connection refused|"
    r".*Caused by:\s*java\.net\.ConnectException:\s*Connection refused|"
    rf"^\s*{TS}?\s*at\s+(?:com\.netflix\.discovery\.|org\.glassfish\.jersey\.|"
    r"jakarta\.ws\.rs\.|org\.apache\.hc\.client5\.|org\.apache\.hc\.core5\.|"
    r"org\.springframework\.web\.client\.DefaultRestClient|"
    r"org\.apache\.maven\.lifecycle\.|org\.apache\.maven\.plugin\.|"
    r"org\.apache\.maven\.DefaultMaven\.|org\.apache\.maven\.cli\.|"
    r"org\.codehaus\.plexus\.|org\.apache\.maven\.plugin\.surefire\.)\b|"
    rf"^\s*{TS}?\s*\.\.\.\s+\d+\s+more\s*$|"
    r"::\s*Spring Boot\s*::|"
    rf"^\s*{TS}?\(v\d+\.\d+\.\d+\)\s*$|"
    rf"^\s*{TS}?\[INFO\]\s+(?:Running com\.|Surefire report directory:|"
    r"Using auto detected provider|T E S T S)\b|"
    r"Mockito is currently self-attaching|"
    r"WARNING:\s+A (?:Java agent|terminally deprecated method|restricted method)|"
    r"WARNING:\s+sun\.misc\.Unsafe|WARNING:\s+Please consider reporting|"
    r"WARNING:\s+.*will be removed in a future release|"
    r"WARNING:\s+.*Use --enable-native-access|"
    r"WARNING:\s+Restricted methods will be blocked"
    r")"
)
TRUNC_NOTICE = "\n... [%d characters omitted; increase MAX_STAGE_LOG_CHARS] ...\n"
BLANK = r"^\s*$"
SNIPPET_BEFORE, SNIPPET_AFTER, SNIPPET_GAP, SNIPPET_MIN_SCORE = 2, 4, 3, 2
OVERLAP_SLACK_MS = 2000
PARALLEL_START = "Execute in parallel : Start"
PARALLEL_END = "Execute in parallel : End"


# ── Scalar helpers ───────────────────────────────────────────────────────────

def parse_feed_title(title: Column, link: Column) -> Column:
    """struct(job_full_name, build_number, build_url) or null when the title has no build."""
    t = F.trim(title)
    m1 = title.rlike(FEED_TITLE)
    job = F.when(m1, F.regexp_extract(title, FEED_TITLE, 1)).otherwise(F.regexp_extract(t, FEED_TITLE_BARE, 1))
    num = F.when(m1, F.regexp_extract(title, FEED_TITLE, 2)).otherwise(F.regexp_extract(t, FEED_TITLE_BARE, 2))
    ok = m1 | t.rlike(FEED_TITLE_BARE)
    return F.when(ok, F.struct(
        F.replace(F.trim(job), F.lit(" » "), F.lit("/")).alias("job_full_name"),
        num.cast("int").alias("build_number"),
        F.concat(F.regexp_replace(link, "/+$", ""), F.lit("/")).alias("build_url")))


def failing_status(status: Column) -> Column:
    """P9."""
    return F.upper(F.coalesce(status, F.lit(""))).isin(*FAILING_STATUSES)


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def strip_html(text: Column) -> Column:
    """Tags removed, all character references decoded, clock prefixes removed per line."""
    return F.regexp_replace(_unescape(F.regexp_replace(text, HTML_TAG, "")), CLOCK_PREFIX, "")


def _sizes(n: Column, max_chars: int) -> tuple[Column, Column]:
    """Characters of head and tail kept of a text of ``n``; nulls where no notice fits beside them."""
    inner = max(200, max_chars - 96)
    head = max(80, int(inner * 0.55))
    pairs = [(head, max(80, inner - head))]
    while pairs[-1] != (40, 40) and sum(pairs[-1]) + 64 > max_chars:      # a notice has more than 64 characters
        pairs.append((max(40, pairs[-1][0] - 30), max(40, pairs[-1][1] - 30)))
    heads, tails = [], []
    for h, t in pairs:
        spare = F.lit(max_chars) - (h + F.length(F.format_string(TRUNC_NOTICE, F.greatest(F.lit(0), n - h - t))) + t)
        half = F.floor(spare / 2).cast("int")
        heads.append(F.when(spare >= 0, h + half))
        tails.append(F.when(spare >= 0, t + spare - half))
    return F.coalesce(*heads), F.coalesce(*tails)


def _shortened(head_text: Column, tail_text: Column, n: Column, head: Column, tail: Column, max_chars: int) -> Column:
    """Head, notice and tail; the bare head where they don't fit. The texts hold the kept ends, at least."""
    omitted = F.greatest(F.lit(0), n - head - tail)
    out = F.concat(F.substring(head_text, F.lit(1), head), F.format_string(TRUNC_NOTICE, omitted),
                   F.substring(tail_text, F.length(tail_text) - tail + 1, tail))
    bare = F.concat(F.substring(head_text, 1, max(0, max_chars - 3)), F.lit("..."))
    return F.when(n <= max_chars, head_text).when(F.length(out) <= max_chars, out).otherwise(bare)


def truncate_chars(text: Column, max_chars: int | None = None) -> Column:
    """Keep head (55%) and tail with an omission notice; whole texts without ``max_chars``."""
    if max_chars is None:
        return text
    if max_chars <= 0:
        return F.lit("")
    n = F.length(text)
    head, tail = _sizes(n, max_chars)
    return _shortened(text, text, n, head, tail, max_chars)


def anchor_score(line: Column) -> Column:
    """Error-anchor score of one console line, null when not an anchor."""
    raw = F.trim(line)
    base = (F.lit(1)
            + F.when(line.rlike(TYPED_THROWABLE), 4).when(line.rlike(ANCHOR_STRONG_WORD), 3).otherwise(0)
            + F.when(line.rlike(ANCHOR_EXIT), 2).otherwise(0)
            + F.when(line.rlike(ANCHOR_SCRIPT_EXIT), 2).otherwise(0)
            + F.when(line.rlike(ANCHOR_CONN), 3).otherwise(0)
            + F.when(line.rlike(OPERATIONAL_HINT), 2).otherwise(0)
            - F.when(raw.rlike(ANCHOR_URL) & (F.size(F.split(F.lower(raw), "error")) - 1 < 2), 2).otherwise(0)
            - F.when(raw.rlike(ANCHOR_FRAME) & ~line.rlike(TYPED_THROWABLE), 2).otherwise(0))
    ok = (F.length(raw) >= 4) & ~line.rlike(BOILERPLATE_ANCHOR) & line.rlike(FAILURE_SIGNAL)
    return F.when(ok, base)


def noise_line(line: Column) -> Column:
    """P10: console boilerplate (matched at the start of the line)."""
    return line.rlike(NOISE_LINE)


def _joined(order_col: str, text_col: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order_col, text_col))), lambda x: x[text_col]), "\n")


def truncate_lines(lines: DataFrame, key: str, max_chars: int | None = None, raw_col: str = "raw",
                   order_col: str = "idx") -> DataFrame:
    """X16 over a text stored as line rows (text = lines joined by LF). Output: key, excerpt.

    The same result as ``truncate_chars`` on the joined text. With ``max_chars`` only lines that overlap the kept
    head or tail are collected; without it the excerpt is the whole text.
    """
    if max_chars is None:
        own = lines.select(key, order_col, F.col(raw_col).alias("_r"))
        return own.groupBy(key).agg(_joined(order_col, "_r").alias("excerpt"))
    if max_chars <= 0:
        return lines.select(key).distinct().withColumn("excerpt", F.lit(""))
    w = Window.partitionBy(key).orderBy(order_col)
    start = F.coalesce(F.sum(F.length(raw_col) + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = lines.select(key, order_col, F.col(raw_col).alias("_r"), start.alias("_s"))
    df = df.withColumn("_n", F.sum(F.length("_r") + 1).over(Window.partitionBy(key)) - 1)
    n = F.col("_n")
    head, tail = _sizes(n, max_chars)
    df = df.withColumn("_head", head).withColumn("_tail", tail)
    small = n <= max_chars
    keep_head = small | (F.col("_s") < F.greatest(F.coalesce("_head", F.lit(0)), F.lit(max_chars)))
    keep_tail = ~small & (F.col("_s") + F.length("_r") >= n - F.coalesce("_tail", F.lit(0)))
    piece = df.filter(keep_head | keep_tail).select(key, order_col, "_n", "_head", "_tail",
                                                   F.when(keep_head, F.struct(order_col, "_r")).alias("_h"),
                                                   F.when(keep_tail, F.struct(order_col, "_r")).alias("_t"))
    g = piece.groupBy(key).agg(
        F.first("_n").alias("_n"), F.first("_head").alias("_head"), F.first("_tail").alias("_tail"),
        *[F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["_r"]), "\n").alias(c) for c in ("_h", "_t")])
    return g.select(key, _shortened(F.col("_h"), F.col("_t"), n, F.col("_head"), F.col("_tail"), max_chars).alias("excerpt"))


# ── Stage grouping ───────────────────────────────────────────────────────────

def overlap_groups(stages: DataFrame, slack_ms: int = OVERLAP_SLACK_MS, build: str = "build_key") -> DataFrame:
    """Per build, stages sorted by start; a new group starts when start >= running max end + slack.

    The running max over all earlier stages equals the current group's end
    because durations are non-negative. Adds ``group_no`` (1-based).
    """
    w = Window.partitionBy(build).orderBy("start_ms", "stage_id")
    prev_end = F.max(F.col("start_ms") + F.col("duration_ms")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = prev_end.isNull() | (F.col("start_ms") >= prev_end + max(0, int(slack_ms)))
    df = stages.withColumn("_new", new.cast("int"))
    return df.withColumn("group_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def parallel_blocks(stages: DataFrame, markers: DataFrame, build: str = "build_key") -> DataFrame:
    """Enclosing parallel block of each stage from Start/End flow-node markers.

    Per build: stages (by start) must have strictly increasing positive ids and
    every opened block must be closed, else the whole build gets ``block=null``
    and ``valid=false`` (callers fall back to W8). Brackets are matched by depth: one window
    over the build's id-ordered events, one over each of its levels.
    """
    ev_s = stages.select(build, F.col("stage_id").alias("id"), F.lit(0).alias("k"), "start_ms")
    ev_m = markers.select(build, F.col("node_id").alias("id"),
                          F.when(F.col("kind") == "start", 1).when(F.col("kind") == "end", 2).otherwise(3).alias("k"),
                          F.lit(None).cast("bigint").alias("start_ms")).filter("k < 3")
    ordered_ok = stages.withColumn(
        "_bad", ((F.col("stage_id") <= 0) | (F.col("stage_id") <= F.coalesce(
            F.lag("stage_id").over(Window.partitionBy(build).orderBy("start_ms", "stage_id")), F.lit(0)))).cast("int")
    ).groupBy(build).agg((F.max("_bad") == 0).alias("_ids_ok"))
    # The stack's depth is the balance of starts and ends above its lowest point so far (an end without a start closes nothing).
    w = Window.partitionBy(build).orderBy("id", "k").rowsBetween(Window.unboundedPreceding, 0)
    evs = ev_s.unionByName(ev_m).withColumn("_bal", F.sum(F.when(F.col("k") == 1, 1).when(F.col("k") == 2, -1).otherwise(0)).over(w))
    evs = evs.withColumn("_depth", F.col("_bal") - F.least(F.lit(0), F.min("_bal").over(w)))
    closed = evs.groupBy(build).agg((F.max_by("_depth", F.struct("id", "k")) == 0).alias("_closed"))
    # The block around a stage is the last start that led to the stage's depth.
    level = Window.partitionBy(build, "_depth").orderBy("id", "k").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("k") == 1, F.col("id")), ignorenulls=True).over(level)
    res = (evs.withColumn("_blk", F.when(F.col("_depth") > 0, opened)).filter("k = 0")
           .select(build, F.col("id").alias("stage_id"), "_blk").join(closed, build))
    res = res.join(ordered_ok, build)
    valid = F.col("_closed") & F.col("_ids_ok")
    return stages.join(res, [build, "stage_id"], "left").select(
        *stages.columns, F.when(valid, F.col("_blk")).alias("block"), F.coalesce(valid, F.lit(False)).alias("valid"))


def root_failures(stages: DataFrame, markers: DataFrame | None = None, slack_ms: int = OVERLAP_SLACK_MS,
                  build: str = "build_key") -> DataFrame:
    """Failed stages of the earliest group (by min start) that has a failure.

    Groups: parallel blocks where markers are valid (stages outside any block
    are singletons), else overlap groups with slack.
    """
    g = overlap_groups(stages, slack_ms, build)
    if markers is not None:
        pb = parallel_blocks(stages, markers, build).select(build, "stage_id", "block", "valid")
        g = g.join(pb, [build, "stage_id"])
        key = F.when(F.col("valid"), F.coalesce(F.concat(F.lit("b"), F.col("block").cast("string")),
                                                F.concat(F.lit("s"), F.col("stage_id").cast("string"))))
        g = g.withColumn("_gkey", F.coalesce(key, F.concat(F.lit("o"), F.col("group_no").cast("string"))))
    else:
        g = g.withColumn("_gkey", F.concat(F.lit("o"), F.col("group_no").cast("string")))
    wg = Window.partitionBy(build, "_gkey")
    g = (g.withColumn("_gstart", F.min("start_ms").over(wg))
         .withColumn("_gfail", F.max(failing_status(F.col("status")).cast("int")).over(wg)))
    g = g.withColumn("_first", F.min(F.when(F.col("_gfail") == 1, F.struct("_gstart", "_gkey"))).over(Window.partitionBy(build)))
    return (g.filter((F.col("_gfail") == 1) & (F.col("_gkey") == F.col("_first._gkey")) & failing_status(F.col("status")))
            .drop("_gkey", "_gstart", "_gfail", "group_no", "_first"))


# ── Stage-log excerpts ───────────────────────────────────────────────────────

def console_section(lines: DataFrame, stage_name: Column, key: str = "log_id", max_chars: int | None = None) -> DataFrame:
    """50 lines before / 150 after the last line naming the stage; whole log otherwise.

    ``lines``: key, idx, raw plus a ``stage_name`` column. Output: key, excerpt (cut if ``max_chars`` is given).
    """
    hit = F.col("raw").contains(F.concat(F.lit("("), stage_name, F.lit(")"))) | F.col("raw").contains(stage_name)
    w = Window.partitionBy(key)
    df = lines.withColumn("_c", F.max(F.when(hit, F.col("idx"))).over(w))
    keep = F.col("_c").isNull() | ((F.col("idx") >= F.col("_c") - 50) & (F.col("idx") < F.col("_c") + 150))
    return truncate_lines(df.filter(keep).select(key, "idx", "raw"), key, max_chars)


def error_signal(lines: DataFrame, key: str = "log_id", first_lines: int | None = None) -> DataFrame:
    """Whether a log has a line with a failure signal (among its first ``first_lines``, if given)."""
    hit = F.col("raw").rlike(FAILURE_SIGNAL)
    if first_lines is not None:
        hit = hit & (F.col("idx") < first_lines)
    return lines.groupBy(key).agg(F.bool_or(hit).alias("has_signal"))


def error_snippets(lines: DataFrame, key: str = "log_id", scan_lines: int | None = None,
                   before: int = SNIPPET_BEFORE, after: int = SNIPPET_AFTER, gap: int = SNIPPET_GAP,
                   regions: int | None = None, min_score: int = SNIPPET_MIN_SCORE, tail_lines: int | None = None,
                   tail_kept: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Compact error regions of a log; its lines that are no noise where it has none.

    All lines and regions count unless ``scan_lines`` (the last ones) or ``regions`` (the best ones)
    are given; ``tail_lines`` and ``tail_kept`` bound the fallback, ``max_chars`` the snippet.
    ``lines``: key, idx, raw. Output: key, snippet.
    """
    w = Window.partitionBy(key)
    df = lines.withColumn("_n", F.count(F.lit(1)).over(w))
    if scan_lines is None:
        df = df.withColumn("_i", F.col("idx")).withColumn("_m", F.col("_n"))
    else:
        df = df.filter(F.col("idx") >= F.col("_n") - scan_lines).withColumn("_i", F.col("idx") - F.greatest(F.lit(0), F.col("_n") - scan_lines))
        df = df.withColumn("_m", F.least(F.col("_n"), F.lit(scan_lines)))
    df = df.withColumn("_sc", anchor_score(F.col("raw"))).withColumn("_noise", noise_line(F.col("raw")) | F.col("raw").rlike(r"^\s*$"))
    anchors = df.filter(F.col("_sc") >= min_score)
    wo = Window.partitionBy(key).orderBy("_i")
    d = F.col("_i") - F.lag("_i").over(wo)
    anchors = anchors.withColumn("_cid", F.sum(F.when(d.isNull() | (d > gap), 1).otherwise(0)).over(wo.rowsBetween(Window.unboundedPreceding, 0)))
    cl = anchors.groupBy(key, "_cid").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"), F.max("_sc").alias("_peak"), F.max("_m").alias("_m"))
    if regions is not None:
        cl = cl.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_peak").desc(), F.col("_hi").desc())))
        cl = cl.filter(F.col("_r") <= regions)
    cl = cl.select(key, F.greatest(F.lit(0), F.col("_lo") - before).alias("_wlo"), F.least(F.col("_m"), F.col("_hi") + after + 1).alias("_whi"))
    # Merge overlapping windows (sorted by start): running max end, new window when start > max end so far.
    ww = Window.partitionBy(key).orderBy("_wlo", "_whi")
    prev = F.max("_whi").over(ww.rowsBetween(Window.unboundedPreceding, -1))
    cl = cl.withColumn("_wid", F.sum(F.when(prev.isNull() | (F.col("_wlo") > prev), 1).otherwise(0)).over(ww.rowsBetween(Window.unboundedPreceding, 0)))
    wins = cl.groupBy(key, "_wid").agg(F.min("_wlo").alias("_wlo"), F.max("_whi").alias("_whi"))
    inwin = df.join(wins, key).filter((F.col("_i") >= F.col("_wlo")) & (F.col("_i") < F.col("_whi")) & ~F.col("_noise"))
    per_win = inwin.groupBy(key, "_wid").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", "raw"))), lambda s: s["raw"]), "\n").alias("_b"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_wid", "_b"))), lambda s: s["_b"]), "\n\n")
    snip = per_win.groupBy(key).agg(F.regexp_replace(joined, r"^\s+|\s+$", "").alias("_s"))
    # W14 fallback: non-blank lines, without noise where any other is left.
    wr = Window.partitionBy(key).orderBy(F.col("idx").desc())
    tail = lines
    if tail_lines is not None:
        tail = tail.withColumn("_k", F.row_number().over(wr)).filter(F.col("_k") <= tail_lines)
    tail = tail.filter(~F.col("raw").rlike(BLANK)).withColumn("_noise", noise_line(F.col("raw")))
    tail = tail.withColumn("_anyclean", F.max((~F.col("_noise")).cast("int")).over(w))
    tail = tail.filter((F.col("_anyclean") == 0) | ~F.col("_noise"))
    if tail_kept is not None:
        tail = tail.withColumn("_k2", F.row_number().over(wr)).filter(F.col("_k2") <= tail_kept)
    fb = tail.groupBy(key).agg(_joined("idx", "raw").alias("_f"))
    keys = lines.select(key).distinct()
    out = keys.join(snip, key, "left").join(fb, key, "left")
    text = F.when(F.coalesce(F.length("_s"), F.lit(0)) > 0, F.col("_s")).otherwise(F.coalesce(F.col("_f"), F.lit("")))
    return out.select(key, truncate_chars(text, max_chars).alias("snippet"))


# ── Feed, watermark, claim ───────────────────────────────────────────────────

def feed_builds(feed: DataFrame) -> DataFrame:
    """X20 over feed items; unparseable titles skipped."""
    p = parse_feed_title(F.col("title"), F.col("link"))
    return feed.filter(~_blank(F.col("title")) & ~_blank(F.col("link"))).select(
        "item_id", p.alias("p")).filter(F.col("p").isNotNull()).select("item_id", "p.*")


def first_per_build(builds: DataFrame) -> DataFrame:
    """Of each (job, build) the feed item with the smallest id (combined on the map side)."""
    keys = ["job_full_name", "build_number"]
    rest = [c for c in builds.columns if c not in (*keys, "item_id")]
    first = builds.groupBy(*keys).agg(F.min(F.struct("item_id", *rest)).alias("_f"))
    return first.select(*[F.col(f"_f.{c}").alias(c) if c not in keys else F.col(c) for c in builds.columns])


def last_processed(state: DataFrame) -> DataFrame:
    """Highest build number known per job (any status)."""
    return state.groupBy("job_full_name").agg(F.max("build_number").alias("last_build"))


def new_builds(builds: DataFrame, state: DataFrame) -> DataFrame:
    """J2 + U1: builds above the job's watermark, one per (job, build) (first feed item)."""
    wm = last_processed(state)
    b = builds.join(wm, "job_full_name", "left").filter(F.col("build_number") > F.coalesce(F.col("last_build"), F.lit(0)))
    return first_per_build(b.select(*builds.columns))


def claimable(candidates: DataFrame, state: DataFrame) -> DataFrame:
    """Unknown builds (inserted as seen) plus known ones in status seen/failed."""
    keys = ["job_full_name", "build_number"]
    fresh = candidates.join(state.select(*keys), keys, "left_anti").select(*keys, F.lit("new").alias("claim"))
    retry = candidates.join(state.filter(F.col("status").isin("seen", "failed")).select(*keys), keys, "left_semi").select(
        *keys, F.lit("retry").alias("claim"))
    return fresh.unionByName(retry)


def event_type(failed_stages: Column) -> Column:
    """stage_failure when any failed stage, else build_failure."""
    return F.when(F.coalesce(F.size(failed_stages), F.lit(0)) > 0, F.lit("stage_failure")).otherwise(F.lit("build_failure"))


def read_feed(spark, path: str) -> DataFrame:
    """Landed Atom (``entry``) and RSS (``item``) files -> (title, link); one scan each, no schema inference.

    An Atom entry's link is the ``href`` of its first link; an RSS item's is the first of its links with a
    text or else an ``href``. Items without title or link are dropped.
    """
    def items(tag: str) -> DataFrame:
        schema = "title string, link array<struct<_VALUE: string, _href: string>>"
        df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
        text = F.transform("link", lambda x: F.coalesce(F.nullif(_trimmed(x["_VALUE"]), F.lit("")), F.nullif(_trimmed(x["_href"]), F.lit(""))))
        link = _trimmed(F.get("link", F.lit(0))["_href"]) if tag == "entry" else F.get(F.filter(text, lambda x: x.isNotNull()), F.lit(0))
        return df.select(_trimmed(F.col("title")).alias("title"), link.alias("link"))

    df = items("entry").unionByName(items("item"))
    return df.filter((F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != ""))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(BLANK)


# ── Failure events and stage-log sources ─────────────────────────────────────

EVENT_SCHEMA = ("struct<job_full_name:string,build_number:int,build_url:string,correlation_id:string,"
                "failed_stages:array<struct<stage_name:string,stage_id:string,status:string,log_excerpt:string>>>")
PAYLOAD_SCHEMA = f"struct<failures:array<{EVENT_SCHEMA}>,job_full_name:string,build_number:int,build_url:string," \
                 "correlation_id:string,failed_stages:array<struct<stage_name:string,stage_id:string,status:string,log_excerpt:string>>>"


def ingest_events(payloads: DataFrame, col: str = "body", max_chars: int | None = None) -> DataFrame:
    """S3: JSON bodies (one event or ``{"failures": [...]}``) to one row per non-blank failed stage.

    Raw logs are whole, or cut at ``max_chars`` if given.
    """
    p = F.from_json(F.col(col), PAYLOAD_SCHEMA)
    single = F.struct(p["job_full_name"].alias("job_full_name"), p["build_number"].alias("build_number"),
                      p["build_url"].alias("build_url"), p["correlation_id"].alias("correlation_id"),
                      p["failed_stages"].alias("failed_stages"))
    events = payloads.select(F.explode(F.coalesce(p["failures"], F.array(single))).alias("e"))
    st = events.select("e.job_full_name", "e.build_number", "e.build_url", "e.correlation_id",
                       F.explode_outer("e.failed_stages").alias("s"))
    st = st.filter(F.col("s").isNotNull() & ~_blank(F.col("s.log_excerpt")))
    return st.select("job_full_name", "build_number", "build_url", "correlation_id", F.col("s.stage_name").alias("stage_name"),
                     F.col("s.stage_id").alias("stage_id"), F.col("s.status").alias("status"),
                     (F.col("s.log_excerpt") if max_chars is None else F.substring("s.log_excerpt", 1, max_chars)).alias("raw"))


def node_log(text: Column) -> Column:
    """A node's log, stripped of white space around it, then of markup; null when nothing is there."""
    return F.when(~_blank(text), F.nullif(strip_html(_trimmed(text)), F.lit("")))


def child_log_concat(child_logs: DataFrame, key: tuple[str, ...] = ("build_key", "stage_id"), order_col: str = "node_id",
                     text_col: str = "text") -> DataFrame:
    """Non-empty child-node logs of a stage, stripped, joined in node order."""
    kids = child_logs.select(*key, order_col, node_log(F.col(text_col)).alias("_t")).filter(F.col("_t").isNotNull())
    return kids.groupBy(*key).agg(_joined(order_col, "_t").alias("child_log"))


def stage_log_cascade(failed: DataFrame, node_logs: DataFrame, child_logs: DataFrame, console_lines: DataFrame,
                      builds: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Excerpt per failed stage: node log, else child logs, else the console section
    naming the stage, else the whole console; builds without a failed stage get one
    synthetic ``Build`` / ``FAILURE`` stage from the console (when it is not blank).
    Excerpts are whole, or cut at ``max_chars`` if given.

    ``failed``: build_key, stage_id, name, status. ``node_logs``: build_key, stage_id, text.
    ``child_logs``: build_key, stage_id, node_id, text. ``console_lines``: build_key, idx, raw.
    ``builds``: build_key.
    """
    kids = child_log_concat(child_logs)
    f = (failed.join(node_logs.select("build_key", "stage_id", node_log(F.col("text")).alias("_node")), ["build_key", "stage_id"], "left")
         .join(kids, ["build_key", "stage_id"], "left"))
    names = failed.select("build_key", F.col("name").alias("stage_name")).distinct()
    sec = console_section(console_lines.join(names, "build_key")
                          .withColumn("_k", F.concat_ws("\u0001", "build_key", "stage_name")), F.col("stage_name"), key="_k", max_chars=max_chars)
    # Whole-console excerpt over line rows (never the whole console in one group), stripped of
    # surrounding whitespace like the console text it stands for; blank consoles give none.
    blank = F.col("raw").rlike(r"^\s*$")
    wb = Window.partitionBy("build_key")
    cl = (console_lines.select("build_key", "idx", "raw")
          .withColumn("_f", F.min(F.when(~blank, F.col("idx"))).over(wb))
          .withColumn("_l", F.max(F.when(~blank, F.col("idx"))).over(wb))
          .filter(F.col("_f").isNotNull() & (F.col("idx") >= F.col("_f")) & (F.col("idx") <= F.col("_l"))))
    raw = F.col("raw")
    raw = F.when(F.col("idx") == F.col("_f"), F.regexp_replace(raw, r"^\s+", "")).otherwise(raw)
    raw = F.when(F.col("idx") == F.col("_l"), F.regexp_replace(raw, r"\s+$", "")).otherwise(raw)
    full = truncate_lines(cl.select("build_key", "idx", raw.alias("raw")), "build_key", max_chars).withColumnRenamed("excerpt", "_full")
    f = f.withColumn("_k", F.concat_ws("\u0001", "build_key", "name")).join(sec.withColumnRenamed("excerpt", "_sec"), "_k", "left")
    f = f.join(full, "build_key", "left")

    def nz(c):
        return F.when(~_blank(c), c)

    excerpt = F.coalesce(truncate_chars(nz(F.col("_node")), max_chars), truncate_chars(nz(F.col("child_log")), max_chars), nz(F.col("_sec")), F.coalesce(F.col("_full"), F.lit("")))
    staged = f.select("build_key", F.col("name").alias("stage_name"), F.col("stage_id").cast("string").alias("stage_id"),
                      F.upper("status").alias("status"), excerpt.alias("log_excerpt"))
    none_failed = builds.select("build_key").join(failed.select("build_key").distinct(), "build_key", "left_anti")
    synth = none_failed.join(full, "build_key").filter(F.col("_full").isNotNull()).select(
        "build_key", F.lit("Build").alias("stage_name"), F.lit(None).cast("string").alias("stage_id"),
        F.lit("FAILURE").alias("status"), F.col("_full").alias("log_excerpt"))
    return staged.unionByName(synth)
