"""Preference formatting: one prompt and two masked completions for each pair of conversations.

A pair names a chosen and a rejected conversation. Their longest common prefix of turns (same role and text) is rendered
once as the prompt; the turns after it are rendered as two completions. A completion's mask lists the character ranges
of its assistant texts, the only ones to train on. By DataFrame operations only.

Turns are ordered by turn, then role and text. Null roles and texts count as empty strings and null turns come first;
turns without a conversation id are left out. A pair with an unknown conversation gives no row, equal conversations give
two empty completions, repeated turns count each time. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rendered(turns: Column) -> Column:
    """The turns in the chat template, one after the other."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """start:end of each assistant text in the rendered turns, comma-joined; code points, end exclusive."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, t):
        begin = acc["at"] + F.length(t["role"]) + 5
        end = begin + F.length(t["text"])
        span = F.concat(F.when(acc["out"] == "", "").otherwise(","), begin.cast("string"), F.lit(":"), end.cast("string"))
        return F.struct((end + 8).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, start, add, lambda acc: acc["out"])


def format_pairs(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs has pair_id, chosen_id and rejected_id; the result has pair_id, chosen_id, rejected_id, n_prompt_turns,
    prompt, chosen, rejected, chosen_mask and rejected_mask."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    sides = F.array(F.struct(F.col("chosen_id").alias("conv"), F.lit(True).alias("first")), F.struct(F.col("rejected_id").alias("conv"), F.lit(False).alias("first")))
    ends = pairs.select("pair_id", "chosen_id", "rejected_id", F.inline(sides)).withColumnsRenamed({"conv": "_conv", "first": "_first"})
    sided = ends.join(whole, F.col("_conv") == F.col("conv_id"))
    both = sided.groupBy("pair_id", "chosen_id", "rejected_id").agg(F.max(F.when(F.col("_first"), F.col("turns"))).alias("a"), F.max(F.when(~F.col("_first"), F.col("turns"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    differs = F.filter(F.sequence(F.lit(1), F.greatest(F.size("a"), F.size("b")) + 1), lambda i: ~F.coalesce((F.get("a", i - 1)["role"] == F.get("b", i - 1)["role"]) & (F.get("a", i - 1)["text"] == F.get("b", i - 1)["text"]), F.lit(False)))
    cut = both.withColumn("n", F.element_at(differs, 1) - 1)
    rest = {side: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0))) for side, c in (("chosen", "a"), ("rejected", "b"))}
    return cut.select("pair_id", "chosen_id", "rejected_id", F.col("n").cast("long").alias("n_prompt_turns"), _rendered(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"), *(_rendered(t).alias(s) for s, t in rest.items()), *(_mask(t).alias(f"{s}_mask") for s, t in rest.items()))
