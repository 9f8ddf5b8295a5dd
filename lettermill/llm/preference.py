"""Preference formatting: one prompt for what two conversations share, and a masked completion for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The role whose words are trained on.
TRAINED = "assistant"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns: each conversation's turns as an array of (role, text), ordered by turn, then role and text.

    Turns without key belong to no conversation and go; a null role or text counts as empty; repeated rows are turns of their own.
    A conversation becomes one row, as its rendering does.
    """
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return grouped.select(key, F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many turns two conversations have in common at their beginning."""
    same = F.zip_with(chosen, rejected, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(F.size(same)).cast("int")


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """Runs of characters as flag:length, flag 1 where a loss is taken: a turn's head never counts, its text and end do in TRAINED turns."""
    run = lambda t: F.concat(F.lit("0:"), F.length(_head(t)).cast("string"), F.when(t["role"] == TRAINED, ",1:").otherwise(",0:"), (F.length(t["text"]) + 1).cast("string"))
    return F.array_join(F.transform(turns, run), ",")


def format_preferences(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, prefix_turns, prompt, chosen, rejected, chosen_mask, rejected_mask.

    pairs: key and the arrays `chosen` and `rejected` of (role, text). The longest common prefix of turns is rendered once, as prompt;
    what follows on either side is its completion with a mask (see _mask). Equal conversations have empty completions, those
    that differ from the first turn on an empty prompt. A null array counts as a conversation without turns. An empty table gives no rows.
    """
    none = F.array().cast("array<struct<role:string,text:string>>")
    sides = pairs.select(key, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    k = sides.withColumn("prefix_turns", shared_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("prefix_turns") + 1, F.greatest(F.size(side) - F.col("prefix_turns"), F.lit(0)))
    return k.select(
        key, "prefix_turns", _rendered(F.slice("c", F.lit(1), F.col("prefix_turns"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"), _rendered(rest("r")).alias("rejected"), _mask(rest("c")).alias("chosen_mask"), _mask(rest("r")).alias("rejected_mask"),
    )


def self_paired(turns: DataFrame) -> DataFrame:
    """Pairs made of one table of conversations: rejected has, in place of the last trained turn's text, that of the first one, or nothing if they are the same."""
    whole = conversations(turns)
    spots = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == TRAINED, i)), lambda i: i.isNotNull())
    at = whole.withColumn("spots", spots)
    last, first = F.try_element_at("spots", F.lit(-1)), F.try_element_at("spots", F.lit(1))
    other = F.when(first < last, F.get("turns", first)["text"]).otherwise(F.lit(""))
    rejected = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, other).otherwise(t["text"]).alias("text")))
    return at.select("conv_id", F.col("turns").alias("chosen"), rejected.alias("rejected"))
