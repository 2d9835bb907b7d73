"""Operator 9: preference formatting of chosen and rejected conversations.

``conversations`` gathers each conversation's turns in order. ``format_pairs`` finds
the longest common prefix of turns of the two sides, renders it once as the prompt,
renders what is left of either side as its completion, and gives the trainable spans of
each completion: the texts of its assistant turns with their closing line feeds. All
of it is DataFrame functions on one row a pair; copies of a conversation are pairs of their own.

Defined cases: a null role or text is an empty one; a null conversation id is no conversation;
rows that repeat a turn wholly count once; turns with one number go by role and
text; a null turn number comes first; equal sides have everything in the prompt and empty
completions; sides without a common turn have an empty prompt; a null rejected side has everything in the
prompt, an empty chosen and a null rejected completion; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import next_at

ASSISTANT = "assistant"


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, turns): an array of (turn, role, text) for each conversation, in order."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                    F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return (turns.where(F.col(conv_col).isNotNull()).groupBy(F.col(conv_col).alias("conv_id"))
            .agg(F.sort_array(F.collect_set(turn)).alias("turns")))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def render(turns: Column) -> Column:
    """``<|role|>``, line feed, text, line feed for each turn."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def trainable(turns: Column) -> Column:
    """Spans (start, end) of the assistant texts in ``render(turns)``, in code points."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + 1
        own = F.array(F.struct(begin.cast("bigint").alias("start"), end.cast("bigint").alias("end")))
        return F.struct(end.cast("bigint").alias("at"),
                        F.when(t["role"] == ASSISTANT, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """``pairs`` with n_prompt_turns, prompt, and completion and spans of both sides, for the two arrays of turns."""
    a, b = F.col(chosen), F.col(rejected)
    same = F.zip_with(a, b, lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    differ = F.array_position(F.transform(same, lambda s: F.coalesce(s, F.lit(False))), False)
    common = F.when(b.isNull() | (differ == 0), F.size(a)).otherwise(differ - 1).cast("int")
    out = pairs.withColumn("n_prompt_turns", common)
    n = F.col("n_prompt_turns")
    out = out.withColumn("prompt", render(F.slice(a, F.lit(1), n)))
    for name in (chosen, rejected):
        rest = F.slice(F.col(name), n + 1, F.size(name))
        out = out.withColumn(f"{name}_completion", render(rest)).withColumn(f"{name}_spans", trainable(rest))
    return out


def replaced_replies(convs: DataFrame, partner: Column | None = None) -> DataFrame:
    """(conv_id, chosen, rejected): each conversation against itself with another's last reply in place of its own.

    The other is the next conversation by its (integer) id that has a reply, the last one takes the first; or the one whose
    id ``partner`` gives. Every conversation has a row: without a reply of its own, or with a partner that is
    missing or has none, its rejected side is null.
    """
    def last(turns: Column) -> Column:
        return F.size(turns) - F.array_position(F.reverse(F.transform(turns, lambda t: t["role"] == ASSISTANT)), True) + 1

    answered = F.exists("turns", lambda t: t["role"] == ASSISTANT)
    own = convs.withColumn("k", F.when(answered, last(F.col("turns"))).cast("int"))
    replies = own.where("k is not null").select(F.col("conv_id").alias("other"), F.get("turns", F.col("k") - 1)["text"].alias("reply"))
    if partner is None:
        own = _with_next(own, replies)
    else:
        own = own.withColumn("other", partner)
    swap = F.array(F.struct(F.get("turns", F.col("k") - 1)["turn"].alias("turn"), F.lit(ASSISTANT).alias("role"),
                            F.col("reply").alias("text")))
    changed = F.concat(F.slice("turns", F.lit(1), F.greatest(F.col("k") - 1, F.lit(0))), swap)
    return own.join(replies, "other", "left").select(
        "conv_id", F.col("turns").alias("chosen"), F.when(F.col("k").isNotNull() & F.col("reply").isNotNull(), changed).alias("rejected"))


def _with_next(own: DataFrame, replies: DataFrame) -> DataFrame:
    """``own`` with ``other``: the next id among ``replies``, found block by block of ids; behind the last comes the first."""
    asked = own.where("k is not null").select(F.lit(0).alias("all"), "conv_id", (F.col("conv_id") + 1).alias("from"))
    found = next_at(replies.select(F.lit(0).alias("all"), F.col("other").alias("idx")), asked, ["all"], "from", "next", 1 << 16)
    first = replies.agg(F.min("other").alias("first"))          # one row
    found = found.join(F.broadcast(first)).select("conv_id", F.coalesce("next", "first").alias("other"))
    return own.join(found, "conv_id", "left")
