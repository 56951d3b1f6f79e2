"""Preference formatting: chosen and rejected conversations with their common start rendered once, and paired masked completions.

All in DataFrame functions on arrays of turns; a conversation is the largest thing a task holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"


def head(turn: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit("\n"))


def body(turn: Column) -> Column:
    return F.concat(F.coalesce(turn["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t))), "")


def common_turns(a: Column, b: Column) -> Column:
    """Number of turns, from the first, that are equal in role and text; null and empty are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(head(x) == head(y), F.lit(False)) & F.coalesce(body(x) == body(y), F.lit(False)) & x.isNotNull() & y.isNotNull())
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def mask(turns: Column, role: str = "assistant") -> Column:
    """(start, end) in characters of the rendered turns, end excluded: what a loss counts, the bodies of the role's turns with their end marks."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(head(t))
        stop = begin + F.length(body(t))
        span = F.array(F.struct(begin.alias("start"), stop.alias("end")))
        return F.struct(stop.alias("at"), F.when(F.coalesce(t["role"] == role, F.lit(False)), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(turns, first, add, lambda s: s["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs (pair_id, chosen, rejected: arrays of (role, text) turns) as prompts and completions; a row for each pair.

    prompt: the longest common start, rendered. chosen, rejected: the other turns, rendered; empty where nothing is left. chosen_mask,
    rejected_mask: the spans in these that a loss counts, those of assistant turns; nothing of the prompt counts. n_common: turns in the
    prompt. Null conversations count as empty, null roles and texts as empty strings. Repeated and null pair_ids come back as given.
    """
    none = F.array().cast(TURN)
    a, b = (F.coalesce(F.col(c).cast(TURN), none) for c in ("chosen", "rejected"))
    at = pairs.select("pair_id", a.alias("a"), b.alias("b")).withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = at.select("pair_id", "n", F.slice("a", 1, F.col("n")).alias("p"), *(F.slice(c, F.col("n") + 1, F.size(c)).alias(c) for c in "ab"))
    return rest.select(
        "pair_id", F.col("n").alias("n_common"), render(F.col("p")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"),
        mask(F.col("a")).alias("chosen_mask"), mask(F.col("b")).alias("rejected_mask"),
    )


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns (conv_id, turn, role, text) of each conversation in the order of turn, then role and text; null first."""
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURN).alias("turns"))


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """A preference pair for each conversation that has an assistant turn, its id as pair_id.

    chosen: the conversation up to its last assistant turn. rejected: the same with that turn's text taken from the last assistant turn of
    the neighbour (ids 2k and 2k+1 are neighbours); without such a turn there, the last turn is left out. Rows without conv_id are left out.
    """
    turns = turns.where("conv_id is not null")
    conv = conversations(turns)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)))
    conv = conv.withColumn("n", last).where("n is not null")
    # of a neighbour only its last assistant text is brought together
    said = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "text"))["text"].alias("other"))
    other = said.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.lit(True).alias("there"), "other")
    both = conv.join(other, "conv_id", "left")
    before = F.slice("turns", 1, F.col("n") - 1)
    swapped = F.array(F.struct(F.lit("assistant").alias("role"), F.col("other").alias("text"))).cast(TURN)
    return both.select(F.col("conv_id").alias("pair_id"), F.slice("turns", 1, F.col("n")).alias("chosen"), F.when(F.col("there"), F.concat(before, swapped)).otherwise(before).alias("rejected"))
