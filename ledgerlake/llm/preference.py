"""Preference formatting: the longest common turn prefix of a chosen and a rejected conversation is rendered once as
the prompt, and what follows as a pair of completions whose masks keep the assistant's words only.

The turns of a conversation are gathered once into its row, which is the only shuffle of their texts; the prefix is
found within the row, turn by turn, and ends before the first place where role or text differ, or one of them has
no turn. All of it is DataFrame functions; equal conversations or first turns elsewhere are never brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_TURNS = "array<struct<role:string,text:string>>"


def gathered(turns: DataFrame, key: str, order: str) -> DataFrame:
    """key and turns, an array of struct(role, text), for each key that isn't null.

    Null roles and texts are empty. Turns with the same number are ordered by role, then text, nulls first, and rows
    that are equal throughout count once.
    """
    one = F.struct(F.col(order).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("pair_id")).agg(F.sort_array(F.collect_set(one)).alias("t"))
    return rows.select("pair_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("\n<|end|>\n"))


def joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")


def mask(turns: Column) -> Column:
    """struct(start, end), in code points of the rendered turns, of the assistant's texts with their end marks."""

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"]) + 9
        spans = F.when(t["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(start.alias("start"), (end - 1).alias("end"))))).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda s: s["spans"])


def formatted(pairs: DataFrame) -> DataFrame:
    """pair_id, n_prefix_turns, prompt, chosen, rejected, chosen_mask and rejected_mask.

    pairs: pair_id, and chosen and rejected as arrays of struct(role, text); a null array is one without turns. A
    row for each row of pairs. The masks say what of a completion is learnt. Equal conversations are all prompt.
    """
    whole = pairs.select("pair_id", *(F.coalesce(F.col(c), F.array().cast(NO_TURNS)).alias(c) for c in ("chosen", "rejected")))
    longest = F.greatest(F.size("chosen"), F.size("rejected"))
    places = F.when(longest > 0, F.sequence(F.lit(0), F.greatest(longest - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~F.get("chosen", i).eqNullSafe(F.get("rejected", i)))
    told = whole.withColumn("n", F.coalesce(F.get(differ, F.lit(0)), longest))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    told = told.select("pair_id", "n", F.slice("chosen", F.lit(1), F.col("n")).alias("p"), rest("chosen").alias("c"), rest("rejected").alias("r"))
    return told.select("pair_id", F.col("n").cast("long").alias("n_prefix_turns"), joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"), mask("c").alias("chosen_mask"), mask("r").alias("rejected_mask"))


def paired(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Pairs from rows (pair_id, turn, role, text) of either side."""
    sides = [gathered(side, "pair_id", "turn").withColumnRenamed("turns", name) for side, name in ((chosen, "chosen"), (rejected, "rejected"))]
    return sides[0].join(sides[1], "pair_id", "full")


def swapped_pairs(turns: DataFrame) -> DataFrame:
    """Pairs from plain conversations: each as it is, and the same with the text of its last assistant turn, if it
    has one, swapped for that of its neighbour (conv_id with the lowest bit flipped), if that has one."""
    own = gathered(turns, "conv_id", "turn")
    spoken = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    own = own.withColumn("last", F.array_max(spoken))
    # the neighbour's last turn from the log itself, so that whole conversations aren't moved again
    said = turns.filter((F.col("role") == "assistant") & F.col("conv_id").isNotNull()).select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("pair_id"), F.struct(F.col("turn"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    other = said.groupBy("pair_id").agg(F.max("t").alias("t")).select("pair_id", F.col("t.text").alias("other"))
    both = own.join(other, "pair_id", "left")
    swap = F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), F.when((i == F.col("last")) & F.col("other").isNotNull(), F.col("other")).otherwise(t["text"]).alias("text")))
    return both.select("pair_id", F.col("turns").alias("chosen"), swap.alias("rejected"))
