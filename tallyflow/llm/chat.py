"""Preference formatting: one prompt and two masked completions for each pair of conversations.

The longest common prefix of the turns of the chosen and the rejected conversation is rendered once, as the prompt; what each has beyond
it is its completion. The mask of a completion lists the spans (code points, end exclusive) of its assistant turns:
their words and the mark that ends them are learned, everything else is context.

A turn is rendered as ``<|role|>``, a line end, the text, ``<|end|>`` and a line end. Null roles and texts are empty. If one conversation is
a prefix of the other (or both are equal) its completion is empty and has no mask. Turns are ordered by number, then role and text, so
that repeated numbers have one order. A conversation is one row by nature; it is never joined with others' turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, messages) from rows (key, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("turn"), role, text)))
    return turns.groupBy(key).agg(F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text"))).alias("messages"))


def head(message: Column) -> Column:
    return F.concat(F.lit("<|"), message["role"], F.lit("|>\n"))


def rendered(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(head(m), m["text"], F.lit(END))), "")


def mask(messages: Column, learned: str = "assistant") -> Column:
    """array<struct<start, end>> of the learned turns in the rendered text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(done: Column, m: Column) -> Column:
        begin = done["at"] + F.char_length(head(m))
        stop = begin + F.char_length(m["text"]) + len(END)
        span = F.array(F.struct(begin.alias("start"), (stop - 1).alias("end")))  # without the line end
        return F.struct(stop.alias("at"), F.when(m["role"] == learned, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return F.aggregate(messages, start, step, lambda done: done["spans"])


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Adds n_prompt_turns, prompt, chosen_text, chosen_mask, rejected_text, rejected_mask to rows with
    ``chosen`` and ``rejected`` (arrays of role and text; null: no turns)."""
    none = F.array().cast(TURNS)
    rows = pairs.withColumns({c: F.coalesce(c, none) for c in ("chosen", "rejected")})
    differs = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    shared = F.when(differs == 0, F.size("chosen")).otherwise(differs - 1)
    rows = rows.withColumn("n_prompt_turns", shared.cast("int"))
    rest = {c: F.slice(c, F.col("n_prompt_turns") + 1, F.size(c)) for c in ("chosen", "rejected")}
    rows = rows.withColumn("prompt", rendered(F.slice("chosen", F.lit(1), F.col("n_prompt_turns"))))
    rows = rows.withColumns({f"_{c}": r for c, r in rest.items()})
    for c in rest:
        rows = rows.withColumns({f"{c}_text": rendered(F.col(f"_{c}")), f"{c}_mask": mask(F.col(f"_{c}"))})
    return rows.drop("_chosen", "_rejected")


def sibling_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected, tail): each conversation up to its last assistant turn, against the same with that
    turn exchanged for the last assistant turn of its sibling (ids 2k and 2k + 1; without one, the turn is left out). ``tail`` has
    the turns after that turn, which belong to neither. Rows with a null conv_id belong to no conversation and are dropped."""
    talks = conversations(turns.filter("conv_id IS NOT NULL"))
    place = F.array_position(F.reverse(F.transform("messages", lambda m: m["role"])), F.lit("assistant"))
    talks = talks.withColumn("last", F.when(place > 0, (F.size("messages") - place + 1).cast("int")))
    other = talks.filter("last IS NOT NULL").select(
        F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.array(F.get("messages", F.col("last") - 1)).alias("reply")
    )
    none = F.array().cast(TURNS)
    before = F.slice("messages", F.lit(1), F.col("last") - 1)
    return talks.join(other, "conv_id", "left").select(
        "conv_id",
        F.when(F.col("last").isNull(), F.col("messages")).otherwise(F.slice("messages", F.lit(1), F.col("last"))).alias("chosen"),
        F.when(F.col("last").isNull(), F.col("messages")).otherwise(F.concat(before, F.coalesce("reply", none))).alias("rejected"),
        F.when(F.col("last").isNull(), none).otherwise(F.slice("messages", F.col("last") + 1, F.size("messages"))).alias("tail"),
    )
