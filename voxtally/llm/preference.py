"""Preference pairs: the shared turns once as prompt, two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = "struct<role:string,text:string>"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                  role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, turns`` in the order of turn number.

    Turns repeated with all four values equal count once; equal numbers are
    ordered by role and text, a NULL number comes last. A NULL role or text is
    an empty string. Turns without a conversation id belong to none and are
    left out.
    """
    item = F.struct(F.col(turn).isNull().alias("last"), F.col(turn).alias("turn"),
                    F.coalesce(F.col(role), F.lit("")).alias("role"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    return (turns.filter(F.col(conv_id).isNotNull())
            .groupBy(F.col(conv_id).alias("conv_id")).agg(F.collect_set(item).alias("all"))
            .select("conv_id", F.transform(F.sort_array("all"), lambda t: F.struct(
                t["role"].alias("role"), t["text"].alias("text"))).alias("turns")))


def shared_turns(chosen: Column, rejected: Column) -> Column:
    """How many leading turns of two conversations are equal in role and text."""
    both = F.least(F.size(chosen), F.size(rejected))
    equal = F.zip_with(F.slice(chosen, 1, both), F.slice(rejected, 1, both), lambda a, b: a == b)
    first = F.array_position(equal, False).cast("int")
    return F.when(first > 0, first - 1).otherwise(both)


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.replace(turn["role"], F.lit("<|"), F.lit("< |")), F.lit("|>\n"))


def _body(turn: Column) -> Column:
    # a marker inside a text must not end its turn
    return F.replace(turn["text"], F.lit("<|"), F.lit("< |"))


END = "<|end|>\n"


def render(turns: Column) -> Column:
    """Turns as text: a role marker, the text, an end marker."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit(END))), "")


def trained_spans(turns: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    """Character spans ``[start, stop)`` of rendered turns to train on.

    The text and end marker of each turn of the given roles; all else is masked.
    """
    size = lambda t: F.length(_head(t)) + F.length(_body(t)) + len(END)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))

    def add(acc: Column, t: Column) -> Column:
        start, stop = acc["at"] + F.length(_head(t)), acc["at"] + size(t)
        span = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(
            t["role"].isin(*roles), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, empty, add)["spans"]


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected",
                 pair_id: str = "pair_id", roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans, usable``.

    ``pairs`` holds two arrays of ``struct<role, text>``. Their longest common
    turn prefix is rendered once; what follows becomes the two completions,
    with the character spans that are trained on. A NULL conversation has no
    turns. Equal conversations, and pairs in which a side has nothing left to
    train on, give no preference: they are kept, with ``usable`` false. Row-local,
    so the number of copies of a turn or conversation does not matter; repeated
    rows are formatted each, other columns are ignored.
    """
    none = F.array().cast(f"array<{TURN}>")
    one = pairs.select(F.col(pair_id).alias("pair_id"), F.coalesce(F.col(chosen).cast(f"array<{TURN}>"), none).alias("c"),
                       F.coalesce(F.col(rejected).cast(f"array<{TURN}>"), none).alias("r"))
    cut = one.withColumn("n", shared_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    tails = cut.select("pair_id", "n", F.slice("c", 1, F.col("n")).alias("p"),
                       rest(F.col("c")).alias("c"), rest(F.col("r")).alias("r"))
    spans = tails.withColumns({"cs": trained_spans(F.col("c"), roles), "rs": trained_spans(F.col("r"), roles)})
    return spans.select("pair_id", F.col("n").alias("n_prompt_turns"), render(F.col("p")).alias("prompt"),
                        render(F.col("c")).alias("chosen"), F.col("cs").alias("chosen_spans"),
                        render(F.col("r")).alias("rejected"), F.col("rs").alias("rejected_spans"),
                        ((F.size("cs") > 0) & (F.size("rs") > 0)).alias("usable"))


def swapped_replies(talks: DataFrame) -> DataFrame:
    """Pairs from single conversations: ``pair_id, chosen, rejected``.

    The rejected side is the conversation with its last turn's text replaced by
    the last text of its neighbour, ids 2k and 2k+1 being neighbours; without a
    neighbour by an empty text. Every conversation is the chosen side of one pair.
    """
    mate = talks.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"),
                        F.element_at("turns", -1)["text"].alias("other"))
    last = F.element_at("turns", -1)
    reply = F.array(F.struct(last["role"].alias("role"), F.coalesce("other", F.lit("")).alias("text")))
    return (talks.join(mate, "conv_id", "left")
            .select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"),
                    F.concat(F.slice("turns", 1, F.size("turns") - 1), reply).alias("rejected")))
