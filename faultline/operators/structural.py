"""Pass 2: structural collapse (W1-W6, A11), block by block of every log.

Input: annotated lines (``log_id, idx, text, template, var_tokens, kind, severity``).
Output adds ``drop`` (bool), ``reason``, ``note`` (strings, '' when unset) and
``score`` (int). The five collapsers run in order (banner, stack, JSON, progress,
repeat), each reading the ``drop`` column left by the previous one.

Passes run inside blocks of a log's lines, see ``blocks``. One scan of block summaries cuts every log into
segments, at lines where no run of stack frames or progress lines is open, and carries the bracket
balance; windows are by (log, segment). Folds and repeat buckets reach over segments: they work on the few
lines that matter, by scans and links. No task holds a whole log and no row collects
one. Nothing is cut: logs, lines and blocks have any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import checkpoint_dir
from . import blocks as BK

LOG = "log_id"
FOLD_BAND = 64      # lines


def _count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def _balance() -> Column:
    """Brackets that a line opens less those that it closes."""
    t = F.col("text")
    return F.when(t == "", 0).otherwise(_count_char(t, "{") + _count_char(t, "[") - _count_char(t, "}") - _count_char(t, "]"))


def init_state(lines: DataFrame) -> DataFrame:
    return (lines.withColumn("drop", F.lit(False)).withColumn("reason", F.lit(""))
            .withColumn("note", F.lit("")).withColumn("score", F.lit(0)))


def drop_banners(df: DataFrame) -> DataFrame:
    """Banner lines are dropped."""
    b = F.col("kind") == P.KIND_BANNER
    return (df.withColumn("drop", F.col("drop") | b)
            .withColumn("reason", F.when(b, F.lit("banner")).otherwise(F.col("reason"))))


def prepared(df: DataFrame, size: int = BK.BLOCK, spans: bool = True) -> DataFrame:
    """What order-dependent passes need from the lines before theirs, in one scan of block summaries.

    ``_b`` is the block, ``_seg`` the line that opens the segment of a line, ``_D`` the bracket balance up to it. A
    segment begins at the first line of a block that is neither a stack frame nor a progress line, so no run of
    these is cut, and windows by (log, segment) see whole runs and about one block.
    """
    df = BK.with_blocks(df, size).withColumn("_delta", _balance())
    loose = F.when(~F.col("kind").isin(P.KIND_STACK, P.KIND_PROGRESS), F.col("idx"))
    opens = F.min(loose).over(Window.partitionBy(LOG, BK.BLK))
    df = df.withColumn("_opens", F.when(opens == F.col("idx"), F.col("idx")))
    df = BK.scan(df, [LOG], {"_seg": ("last", F.col("_opens")), "_D": ("sum", F.col("_delta"))}, spans=spans).drop("_opens")
    return df.withColumn("_seg", F.coalesce("_seg", F.lit(-1)))


def _prepared(df: DataFrame, size: int) -> DataFrame:
    """A pass may be called alone."""
    return df if "_seg" in df.columns else prepared(df, size)


def _w(*extra: str):
    return Window.partitionBy(LOG, "_seg", *extra).orderBy("idx")


def _islands(df: DataFrame, kind: int, name: str) -> DataFrame:
    """Maximal runs of one kind: ``name`` = the run's number in its segment (null outside)."""
    is_k = F.col("kind") == kind
    return df.withColumn(name, F.when(is_k, F.sum((~is_k).cast("int")).over(_w().rowsBetween(Window.unboundedPreceding, 0))))


def _first_of(df: DataFrame, run: str, n: int) -> DataFrame:
    """The first ``n`` lines of every run: of each of its blocks, then of these."""
    for keys in ([LOG, run, BK.BLK], [LOG, run]):
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))).filter(F.col("_r") <= n)
    return df.drop("_r")


def project_frame(text: Column) -> Column:
    """True when no framework hint occurs in the frame text."""
    return ~reduce(lambda a, b: a | b, [text.contains(h) for h in P.PKG_MGR_HINTS])


def collapse_stacks(df: DataFrame, keep_project: int = P.STACK_KEEP_PROJECT, size: int = BK.BLOCK) -> DataFrame:
    """Stack runs longer than 4 keep the top frame and the first project frames."""
    df = _islands(_prepared(df, size), P.KIND_STACK, "_srun")
    ws = _w("_srun")
    wsa = Window.partitionBy(LOG, "_seg", "_srun")
    off = F.row_number().over(ws) - 1
    df = df.withColumn("_off", F.when(F.col("_srun").isNotNull(), off))
    proj = project_frame(F.col("text")) & (F.col("_off") >= 1)
    df = df.withColumn("_prank", F.sum(proj.cast("int")).over(ws.rowsBetween(Window.unboundedPreceding, 0)))
    keep = (F.col("_off") == 0) | (proj & (F.col("_prank") <= keep_project))
    df = df.withColumn("_keep", F.when(F.col("_srun").isNotNull(), keep))
    df = (df.withColumn("_rlen", F.count(F.lit(1)).over(wsa))
          .withColumn("_nkeep", F.sum(F.col("_keep").cast("int")).over(wsa))
          .withColumn("_lastkeep", F.max(F.when(F.col("_keep"), F.col("idx"))).over(wsa)))
    big = F.col("_srun").isNotNull() & (F.col("_rlen") > max(4, keep_project + 1))
    elided = F.col("_rlen") - F.col("_nkeep")
    return (
        df.withColumn("score", F.col("score") + F.when(big & (F.col("_off") == 0), 3).when(big & F.col("_keep"), 2).otherwise(0))
        .withColumn("drop", F.col("drop") | (big & ~F.col("_keep")))
        .withColumn("reason", F.when(big & ~F.col("_keep"), F.lit("stack-frame-elided")).otherwise(F.col("reason")))
        .withColumn("note", F.when(big & (elided > 0) & (F.col("idx") == F.col("_lastkeep")),
                                   F.format_string("... %d frame(s) elided ...", elided)).otherwise(F.col("note")))
        .drop("_srun", "_off", "_prank", "_keep", "_rlen", "_nkeep", "_lastkeep")
    )


def _same(d: DataFrame) -> DataFrame:
    return d


def json_folds(df: DataFrame, max_run: int | None, min_run: int, size: int, spans: bool = True) -> DataFrame | None:
    """(log_id, _s, _e): the folded blocks, from their opening line to the line behind their end; None without an opener."""
    opener = (F.col("kind") == P.KIND_JSON) & ~F.col("drop") & (F.col("text") != "") & (F.col("_delta") > 0)
    level = (F.col("_D") - F.col("_delta")).cast("int")
    checkpoint_dir(df.sparkSession)
    edges = df.filter(opener | (F.col("_delta") < 0)).select(
        LOG, BK.BLK, "idx", opener.alias("_opens"), level.alias("_before"), F.col("_D").cast("int").alias("_after")).checkpoint()
    if edges.filter("_opens").isEmpty():
        return None
    ops = edges.filter("_opens").select(LOG, BK.BLK, "idx", F.col("_before").alias("_level"), F.lit(None).cast("int").alias("_cross"))
    crossings = edges.filter("_after < _before").select(
        LOG, BK.BLK, "idx", F.explode(F.sequence("_after", F.col("_before") - 1)).alias("_level"), F.col("idx").alias("_cross"))
    both = BK.scan(ops.unionByName(crossings), [LOG, "_level"], {"_close": ("first", F.col("_cross"))}, ahead=True, own=False, spans=spans)
    lines = df.groupBy(LOG).agg(F.count(F.lit(1)).cast("int").alias("_n"))
    ends = both.filter(F.col("_cross").isNull()).join(lines, LOG)
    end = F.coalesce(F.col("_close") + 1, F.col("_n"))
    end = end if max_run is None else F.least(end, F.col("idx") + max_run, F.col("_n"))
    ends = ends.select(LOG, BK.BLK, "idx", end.cast("int").alias("_e")).checkpoint()
    if max_run is None:
        outer = (BK.scan(ends, [LOG], {"_before": ("max", F.col("_e"))}, own=False, spans=spans)
                 .filter(F.col("_before").isNull() | (F.col("_before") <= F.col("idx"))))
    else:
        links = BK.next_at(ends, ends, [LOG], "_e", "nxt", size, spans)
        starts = ends.groupBy(LOG).agg(F.min("idx").alias("idx"))
        outer = ends.join(BK.greedy_chain(starts, links, [LOG]).withColumn("idx", F.col("idx").cast("int")), [LOG, "idx"])
    return outer.filter(F.col("_e") - F.col("idx") >= min_run).select(LOG, F.col("idx").alias("_s"), "_e").checkpoint()


def fold_json(df: DataFrame, max_run: int | None = None, min_run: int = P.JSON_MIN_RUN, reuse=_same, size: int = BK.BLOCK,
              spans: bool = True) -> DataFrame:
    """Fold balanced multi-line JSON blocks opened by a JSON line.

    1. an opener's block ends with the first later line whose bracket balance falls to the level before
       the opener. A line crosses the levels between its own and the previous balance, so the openers and
       crossings of one (log, level) are scanned from the end for the next crossing. Blocks that never close go to
       the log's end; ``max_run`` bounds a block, if given;
    2. blocks nest, so the outermost ones are those that no earlier block covers (a running maximum
       of ends). Bounded blocks may not nest; then each chosen block leads to the first opener behind it;
    3. lines meet the folds in bands of ``FOLD_BAND`` lines: folds don't overlap, so a line meets one at most.
    """
    df = reuse(_prepared(df, size))
    folds = json_folds(df, max_run, min_run, size, spans)
    if folds is None:
        return df
    band = F.explode(F.sequence(F.floor(F.col("_s") / FOLD_BAND), F.floor((F.col("_e") - 1) / FOLD_BAND))).alias("_band")
    spans = folds.select(F.col(LOG).alias("_log"), "_s", "_e", band)
    at = ((F.col(LOG) == F.col("_log")) & (F.floor(F.col("idx") / FOLD_BAND) == F.col("_band"))
          & (F.col("idx") >= F.col("_s")) & (F.col("idx") < F.col("_e")))
    key = F.nullif(F.regexp_extract("text", P.J(P.JSON_KEY), 1), F.lit(""))
    named = (df.filter(F.col("text") != "").select(LOG, BK.BLK, "idx", key.alias("_key")).filter("_key is not null")
             .join(spans, at).filter("idx > _s").select(LOG, BK.BLK, "idx", "_s", "_key"))
    keys = _first_of(named, "_s", 5).groupBy(LOG, "_s").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "_key"))), lambda x: x["_key"]).alias("_keys"))    # five at most
    heads = folds.join(keys, [LOG, "_s"], "left").select(LOG, F.col("_s").alias("idx"), "_keys")
    df = df.join(spans, at, "left").drop("_log", "_band").join(heads, [LOG, "idx"], "left")
    is_head = F.coalesce(F.col("idx") == F.col("_s"), F.lit(False))
    inside = F.coalesce(F.col("idx") > F.col("_s"), F.lit(False))
    note = F.format_string("<json: %d lines, top-keys=[%s]>", F.col("_e") - F.col("idx"),
                           F.coalesce(F.array_join("_keys", ","), F.lit("?")))
    return (
        df.withColumn("drop", F.col("drop") | inside)
        .withColumn("reason", F.when(inside, F.lit("json-folded")).when(is_head, F.lit("json-summary")).otherwise(F.col("reason")))
        .withColumn("note", F.when(is_head, note).otherwise(F.col("note")))
        .drop("_s", "_e", "_keys")
    )


def collapse_progress(df: DataFrame, min_run: int = P.PROGRESS_MIN_RUN, size: int = BK.BLOCK) -> DataFrame:
    """A progress island from its first live line on collapses when long enough."""
    df = _islands(_prepared(df, size), P.KIND_PROGRESS, "_prun")
    wa = Window.partitionBy(LOG, "_seg", "_prun")
    df = (df.withColumn("_first", F.min(F.when(~F.col("drop"), F.col("idx"))).over(wa))
          .withColumn("_last", F.max("idx").over(wa)))
    rlen = F.col("_last") - F.col("_first") + 1
    active = F.col("_prun").isNotNull() & F.col("_first").isNotNull() & (rlen >= min_run)
    head_line = active & (F.col("idx") == F.col("_first"))
    tail = active & (F.col("idx") > F.col("_first"))
    head = F.coalesce(F.nullif(F.regexp_extract("text", r"^(\S+(?: \S+)?)", 1), F.lit("")), F.lit("progress"))
    return (
        df.withColumn("drop", F.col("drop") | tail)
        .withColumn("reason", F.when(tail, F.lit("progress-elided")).when(head_line, F.lit("progress-summary")).otherwise(F.col("reason")))
        .withColumn("note", F.when(head_line, F.format_string("<progress: %d lines elided (%s)>", rlen, head)).otherwise(F.col("note")))
        .drop("_prun", "_first", "_last")
    )


def first_values(rows: DataFrame, n: int = 3) -> DataFrame:
    """Per (log, ``_head``) the first ``n`` distinct masked values (labels skipped, each cut to 40 chars), as ``_vals``."""
    toks = (rows.select(LOG, "_head", "idx", F.posexplode("var_tokens").alias("_p", "_tok"))
            .filter(~F.col("_tok").isin(*P.MASK_LABELS)))
    short = F.when(F.length("_tok") <= 40, F.col("_tok")).otherwise(F.concat(F.substring("_tok", 1, 37), F.lit("...")))
    firsts = toks.groupBy(LOG, "_head", short.alias("_tok")).agg(F.min(F.struct("idx", "_p")).alias("_at"))
    firsts = firsts.withColumn("_r", F.row_number().over(Window.partitionBy(LOG, "_head").orderBy("_at"))).filter(F.col("_r") <= n)
    return firsts.groupBy(LOG, "_head").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "_tok"))), lambda x: x["_tok"]), ", ").alias("_vals"))


def bucket_heads(el: DataFrame, window: int, size: int = BK.BLOCK, spans: bool = True) -> DataFrame:
    """(log_id, _b, idx, _head): the first line of the bucket that each of ``el`` (log_id, _b, idx, template) is in.

    A bucket opened at eligible line ``s`` closes at the first eligible line (any template) behind ``s + window``
    and includes it when the template matches; the next one opens at the template's first line behind that. A line
    opens a bucket for sure if the template's line before it closes earlier, whatever came before; only
    where lines lie closer, the openings form chains, whose links are followed by doubling.
    """
    place = [LOG, "template"]
    checkpoint_dir(el.sparkSession)
    el = BK.next_at(el, el.withColumn("_from", F.col("idx") + window + 1), [LOG], "_from", "_close", size, spans).drop("_from")
    el = el.checkpoint() if spans else el
    el = BK.scan(el, place, {"_pc": ("last", F.struct(F.coalesce("_close", F.lit(1 << 40)).alias("c")))}, own=False, spans=spans)
    sure = F.col("_pc").isNull() | (F.col("_pc.c") < F.col("idx"))
    el = el.withColumn("_sure", F.when(sure, F.struct("idx", "_close"))).drop("_pc")
    el = BK.scan(el.checkpoint() if spans else el, place, {"_seg": ("last", F.col("_sure"))}, spans=spans).checkpoint()
    dense = el.filter(F.col("idx") > F.col("_seg._close")).select(*place, F.col("_seg.idx").alias("_s")).distinct()
    rows = el.withColumn("_s", F.col("_seg.idx")).join(dense, [*place, "_s"], "left_semi").select(*place, BK.BLK, "idx", "_s", "_close")
    rows = rows.checkpoint()
    opens = F.col("_sure.idx")
    if not rows.isEmpty():
        links = BK.next_at(rows, rows.withColumn("_behind", F.col("_close") + 1).filter("_behind is not null"), place, "_behind", "nxt", size, spans)
        heads = BK.greedy_chain(rows.filter("idx = _s"), links, place).select(*place, F.col("idx").cast("int").alias("idx"), F.lit(True).alias("_new"))
        el = el.join(heads, [*place, "idx"], "left")
        opens = F.when(F.col("_new") | F.col("_sure").isNotNull(), F.col("idx"))
    el = el.select(LOG, BK.BLK, "idx", "template", opens.alias("_opens"))
    return BK.scan(el.checkpoint() if spans else el, place, {"_head": ("last", F.col("_opens"))}, spans=spans).select(LOG, BK.BLK, "idx", "_head")


def dedupe_repeats(df: DataFrame, window: int = P.REPEAT_WINDOW, min_count: int = P.REPEAT_MIN_COUNT, reuse=_same,
                   size: int = BK.BLOCK, spans: bool = True) -> DataFrame:
    """Anchored repeat buckets per template; keep first and last, note on last.

    A bucket holds ``window`` + 2 lines at most, so its windows are small whatever the log's size.
    """
    df = reuse(BK.with_blocks(df, size))
    eligible = ~F.col("drop") & (F.col("text") != "") & (F.col("severity") < P.SEV_ERROR)
    el = df.filter(eligible)
    heads = bucket_heads(el.select(LOG, BK.BLK, "idx", "template"), window, size, spans)
    el = el.select(LOG, BK.BLK, "idx", "var_tokens").join(heads, [LOG, BK.BLK, "idx"])
    wb = Window.partitionBy(LOG, "_head")
    el = (el.withColumn("_cnt", F.count(F.lit(1)).over(wb))
          .withColumn("_first", F.min("idx").over(wb))
          .withColumn("_lastb", F.max("idx").over(wb)))
    el = reuse(el.filter(F.col("_cnt") >= min_count))
    el = el.join(first_values(el), [LOG, "_head"], "left")
    el = el.withColumn("_vals", F.coalesce("_vals", F.lit("")))
    marks = el.select(
        LOG, BK.BLK, "idx",
        ((F.col("idx") > F.col("_first")) & (F.col("idx") < F.col("_lastb"))).alias("_mid"),
        (F.col("idx") == F.col("_lastb")).alias("_islast"),
        F.when(F.col("idx") == F.col("_lastb"), F.format_string(
            "(repeated %dx over %d lines%s)", F.col("_cnt"), F.col("_lastb") - F.col("_first") + 1,
            F.when(F.col("_vals") != "", F.concat(F.lit(": values="), F.col("_vals"))).otherwise(F.lit(""))
        )).alias("_rnote"),
    )
    df = df.join(marks, [LOG, BK.BLK, "idx"], "left")
    mid = F.coalesce(F.col("_mid"), F.lit(False))
    last = F.coalesce(F.col("_islast"), F.lit(False))
    return (
        df.withColumn("drop", F.col("drop") | mid)
        .withColumn("reason", F.when(mid, F.lit("repeat-elided")).when(last, F.lit("repeat-summary")).otherwise(F.col("reason")))
        .withColumn("note", F.when(last, F.col("_rnote")).otherwise(F.col("note")))
        .drop("_mid", "_islast", "_rnote")
    )


def collapse(lines: DataFrame, reuse=_same, size: int = BK.BLOCK) -> DataFrame:
    """All five collapsers in their fixed order.

    ``reuse`` (e.g. persist) is applied where a pass reads its input in several branches; ``size`` is the number of
    lines in a block.
    """
    blocked = BK.with_blocks(lines, size)
    # Two numbers to the driver: whether a log has a second block, and whether a line may open a JSON block (else none is folded).
    spans, opens = (bool(x) for x in blocked.agg(F.max(BK.BLK) > 0, F.max((F.col("kind") == P.KIND_JSON) & (_balance() > 0))).first())
    df = blocked if "_seg" in blocked.columns else prepared(blocked, size, spans)
    df = drop_banners(init_state(df))
    df = collapse_stacks(df, size=size)
    df = fold_json(df, reuse=reuse, size=size, spans=spans) if opens else df
    df = collapse_progress(df, size=size)
    df = dedupe_repeats(df, reuse=reuse, size=size, spans=spans)
    return df.drop(*[c for c in ("_delta", "_D", "_seg", BK.BLK) if c not in lines.columns])


def collapse_stats(collapsed: DataFrame) -> DataFrame:
    """Dropped lines per collapse reason, one row per log (all five reasons)."""
    aggs = [F.count_if(F.col("drop") & (F.col("reason") == r)).alias(r.replace("-", "_")) for r in P.COLLAPSE_REASONS]
    return collapsed.groupBy(LOG).agg(*aggs)
