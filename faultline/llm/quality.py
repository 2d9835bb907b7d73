"""Operator 6: quality rules with adaptive thresholds (DataFrame functions only).

Every document is measured (counts of words, symbols, repeated lines, repeated
five-word windows). The measures of the documents that pass the base rule go
into quantile sketches per language and source: log-linear integer histograms
(exact below 256, then 128 bins an octave), which merge by adding counts, so
hot sources combine on the map side and a thin group can fall back to the merged sketch of
its language, then of the corpus. Far-out fences (quartiles plus three
interquartile ranges, and a margin at least) replace fixed cutoffs; the fences
are joined to the documents, which are filtered by them.

Defined cases: a null text has no words and fails the base rule; null languages
or sources form groups of their own; repeated rows count each; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, WHITE_RE, fresh, written

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]+"
MIN_GROUP = 20                 # documents a sketch needs before it sets a threshold

#: measure -> (margin below the lower quartile, margin above the upper one); None: no fence
FENCES = {
    "symbol_permille": (None, 100),
    "dup_line_permille": (None, 300),
    "repeat_permille": (None, 100),
    "word_len_centi": (200, 400),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """Add the struct column ``into`` with the counts, ``base_failed`` and the scaled measures."""
    names = {k: fresh(docs, f"_q_{k}") for k in
             ("trim", "words", "lines", "hash", "keys", "sorted", "at")}
    c = {k: F.col(v) for k, v in names.items()}
    body = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<string>")
    df = docs.withColumn(names["trim"], F.btrim(body, F.lit(WHITE)))
    df = df.withColumn(names["words"], F.when(c["trim"] == "", none).otherwise(F.split(c["trim"], WHITE_RE, -1)))
    df = df.withColumn(names["lines"], F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != ""))
    df = df.withColumn(names["hash"], F.transform(c["words"], lambda w: F.xxhash64(w)))
    n = F.size(c["words"])
    hashed = c["hash"]
    df = df.withColumn(names["keys"], F.when(n > WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(hashed, i + j) for j in range(WINDOW)]))))
    keys = c["keys"]
    repeats = F.size(F.array_distinct(keys)) < F.size(keys)
    df = df.withColumn(names["sorted"], F.when(repeats, F.sort_array(F.transform(
        keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    s = c["sorted"]
    df = df.withColumn(names["at"], F.when(s.isNotNull(), F.sort_array(F.transform(
        F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                 lambda j: (F.get(s, j).k == F.get(s, j - 1).k) | (F.get(s, j).k == F.get(s, j + 1).k)),
        lambda j: F.get(s, j).i))))
    at = c["at"]
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size(at) - 1), F.lit(0),
        lambda acc, j: acc + F.coalesce(F.least(F.lit(WINDOW), F.get(at, j + 1) - F.get(at, j)), F.lit(WINDOW)))
    counts = {
        "n_words": n,
        "word_chars": F.length(F.array_join(c["words"], "")),
        "n_symbols": F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, "")),
        "n_lines": F.size(c["lines"]),
        "n_dup_lines": F.size(c["lines"]) - F.size(F.array_distinct(c["lines"])),
        "n_repeat_words": F.coalesce(F.when(at.isNotNull(), covered), F.lit(0)),
    }
    # a generator of one row: no filter above it can pull the measures' expressions apart and repeat them
    one = F.explode(F.array(F.struct(*[v.cast("bigint").alias(k) for k, v in counts.items()]))).alias(into)
    return df.select(*[F.col(f"`{c}`") for c in docs.columns if c != into], one).withColumn(into, _scaled(into))


def _scaled(into: str) -> Column:
    def ratio(a: str, b: str, scale: int) -> Column:
        return F.expr(f"({a} * {scale}) div greatest({b}, 1)")

    q, pre = F.col(into), f"`{into}`."
    failed = (q.n_words < MIN_WORDS) | (100 * q.n_repeat_words > MAX_REPEAT_PERCENT * q.n_words)
    return F.struct(
        *[q[k].alias(k) for k in COUNTS], failed.alias("base_failed"),
        ratio(pre + "n_symbols", pre + "n_words", 1000).alias("symbol_permille"),
        ratio(pre + "n_dup_lines", pre + "n_lines", 1000).alias("dup_line_permille"),
        ratio(pre + "n_repeat_words", pre + "n_words", 1000).alias("repeat_permille"),
        ratio(pre + "word_chars", pre + "n_words", 100).alias("word_len_centi"))


def _bin(x: Column) -> Column:
    """Lower end of the log-linear bin: exact below 256, then 128 bins an octave."""
    shift = F.greatest(F.length(F.bin(x)) - 8, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, shift), shift)


def sketches(measured: DataFrame, q: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Quantile sketches (lang, source, measure, bin, n) of the documents that pass the base rule."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), _bin(F.col(q)[m]).alias("bin")) for m in FENCES])
    return (measured.where(~F.col(q).base_failed)
            .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.explode(pairs).alias("p"))
            .groupBy("lang", "source", F.col("p.measure").alias("measure"), F.col("p.bin").alias("bin"))
            .agg(F.count("*").alias("n")))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row (lang, source, lo_<measure>, hi_<measure>...) per group of the sketches.

    A group under ``min_group`` documents takes the merged sketch of its language, and
    that of the corpus where the language is as thin.
    """
    group = F.struct("lang", "source")
    levels = [(0, F.to_json(F.struct("lang", "source"))), (1, F.to_json(F.struct("lang"))), (2, F.lit(""))]
    merged = (sketch.select("measure", "bin", "n", F.explode(F.array(*[
        F.struct(F.lit(lv).alias("level"), key.alias("key")) for lv, key in levels])).alias("g"))
        .groupBy("g.level", "g.key", "measure", "bin").agg(F.sum("n").alias("n")))
    # one row per bin: a bounded number for any group, however many documents it has
    seen = F.expr("sum(n) over (partition by level, key, measure order by bin)")
    total = F.expr("sum(n) over (partition by level, key, measure)")
    quartiles = (merged.select("level", "key", "measure", "bin", seen.alias("seen"), total.alias("total"))
                 .groupBy("level", "key", "measure")
                 .agg(F.max("total").alias("total"),
                      F.min(F.when(F.expr("seen * 4 >= total"), F.col("bin"))).alias("q1"),
                      F.min(F.when(F.expr("seen * 4 >= total * 3"), F.col("bin"))).alias("q3")))
    groups = sketch.select("lang", "source").distinct().select(
        "lang", "source", F.explode(F.array(*[
            F.struct(F.lit(lv).alias("level"), key.alias("key")) for lv, key in levels])).alias("g"))
    chosen = (groups.select("lang", "source", "g.level", "g.key").join(quartiles, ["level", "key"])
              .where((F.col("total") >= min_group) | (F.col("level") == 2))
              .groupBy("lang", "source", "measure")
              .agg(F.min_by(F.struct("q1", "q3"), "level").alias("q")))
    spread = F.expr("3 * (q.q3 - q.q1)")
    lo = F.create_map(*[x for m, (a, _) in FENCES.items() for x in (F.lit(m), F.lit(a).cast("bigint"))])
    hi = F.create_map(*[x for m, (_, b) in FENCES.items() for x in (F.lit(m), F.lit(b).cast("bigint"))])
    fenced = chosen.select(
        "lang", "source", "measure",
        F.when(lo[F.col("measure")].isNotNull(), F.col("q.q1") - F.greatest(spread, lo[F.col("measure")])).alias("lo"),
        (F.col("q.q3") + F.greatest(spread, hi[F.col("measure")])).alias("hi"))
    aggs = [F.max(F.when(F.col("measure") == m, F.col(e))).alias(f"{e}_{m}") for m in FENCES for e in ("lo", "hi")]
    return fenced.groupBy("lang", "source").agg(*aggs)


def judge(measured: DataFrame, limits: DataFrame, q: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """Join the fences of each document's group and add ``kept`` to the struct ``q``.

    A group that has no sketch holds only documents that fail the base rule.
    """
    t = fresh(measured, "_q_limits")
    side = limits.select(F.struct(*limits.columns).alias(t))
    at = F.col(t)
    joined = measured.join(side, F.col(lang).eqNullSafe(at.lang) & F.col(source).eqNullSafe(at.source), "left")
    inside = F.lit(True)
    for m in FENCES:
        inside = inside & F.coalesce(F.col(q)[m] <= at[f"hi_{m}"], F.lit(True))
        inside = inside & F.coalesce(F.col(q)[m] >= at[f"lo_{m}"], F.lit(True))
    return joined.withColumn(q, F.col(q).withField("kept", ~F.col(q).base_failed & inside)).drop(t)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
        keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, str]:
    """Measure every document once; returns (measures, thresholds, name of the measures' struct).

    The measures are written without the texts, ``keep`` names further columns to carry.
    The thresholds, one row a group, are written too: their known size lets
    Spark broadcast them or, when there are very many sources, join by shuffle.
    """
    q = fresh(docs, "q")
    measured = measure(docs.select(text, lang, source, *keep), q, text).select(lang, source, *keep, q)
    measured = written(measured, "quality-measures")
    return measured, written(thresholds(sketches(measured, q, lang, source)), "quality-limits"), q


def quality_filter(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass the base rule and their group's thresholds, with their own columns."""
    q = fresh(docs, "q")
    measured = written(measure(docs, q, text), "quality-measured")      # texts are measured once
    limits = written(thresholds(sketches(measured, q, lang, source)), "quality-limits")
    judged = judge(measured, limits, q, lang, source)
    return judged.where(F.col(q).kept).select(*docs.columns)
