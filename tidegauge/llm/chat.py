"""Preference formatting: shared turns once as prompt, then two masked completions.

Chosen and rejected conversations come as rows of turns. Turns of a pair are matched by their place, and
the prompt is their longest common prefix. It is rendered once, and each side's remaining turns as a
completion with a mask: the stretches of the completion that a model learns from, which are the
assistant's texts and their end marks.

Everything is grouped by pair; the first place where the sides differ is a minimum, so it is
pre-aggregated, and only rendering brings the turns of one pair together.

Defined results: turns are ordered by ``turn``; of repeated rows of a place the one with the smallest
role and text stands; rows without pair or turn are left out. A null role is written as ``user``, a
null text as an empty one. A pair with one side only, or with equal sides, is returned with
its ``status`` and no completions for training (``status`` <> 'pair'). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
ASSISTANT = "assistant"


def _turns(turns: DataFrame, side: str) -> DataFrame:
    content = F.struct(F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.where("pair_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("pair_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), content.alias("c")
    )
    return rows.groupBy("pair_id", "turn").agg(F.min("c").alias(side))


def rendered(role: Column, text: Column) -> Column:
    head, tail = OPEN.split("{role}")
    return F.concat(F.lit(head), role, F.lit(tail), text, F.lit(CLOSE))


def format_preferences(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row per pair of two tables (pair_id, turn, role, text): prompt, chosen, rejected, the learnt
    stretches of either completion (start and end in characters), the numbers of turns, and status."""
    both = _turns(chosen, "chosen").join(_turns(rejected, "rejected"), ["pair_id", "turn"], "full")
    item = F.struct("turn", "chosen", "rejected")
    pairs = both.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(item)).alias("t"),
        F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("turn"))).alias("differs"),
        F.count("chosen").alias("n_chosen_turns"),
        F.count("rejected").alias("n_rejected_turns"),
    )
    common = F.when(F.col("differs").isNull(), F.size("t")).otherwise(F.size(F.filter("t", lambda x: x["turn"] < F.col("differs"))))
    pairs = pairs.withColumn("cut", common)
    whole = lambda turns, side: F.array_join(F.transform(turns, lambda x: rendered(x[side]["role"], x[side]["text"])), "")
    prompt = whole(F.slice("t", F.lit(1), F.col("cut")), "chosen")
    # a side may be shorter than the other
    rest = lambda side: F.filter(F.slice("t", F.col("cut") + 1, F.greatest(F.size("t") - F.col("cut"), F.lit(0))), lambda x: x[side].isNotNull())
    pairs = pairs.withColumns({"prompt": prompt, "_c": rest("chosen"), "_r": rest("rejected")})
    status = (
        F.when(F.col("n_rejected_turns") == 0, "no_rejected").when(F.col("n_chosen_turns") == 0, "no_chosen")
        .when(F.col("differs").isNull(), "equal").otherwise("pair")
    )
    return pairs.select(
        "pair_id",
        status.alias("status"),
        F.when(F.col("n_rejected_turns") * F.col("n_chosen_turns") > 0, F.col("cut")).otherwise(0).cast("long").alias("n_prompt_turns"),
        "n_chosen_turns",
        "n_rejected_turns",
        "prompt",
        whole(F.col("_c"), "chosen").alias("chosen"),
        whole(F.col("_r"), "rejected").alias("rejected"),
        _learnt(F.col("_c"), "chosen").alias("chosen_mask"),
        _learnt(F.col("_r"), "rejected").alias("rejected_mask"),
    )


def _learnt(turns: Column, side: str) -> Column:
    """Stretches of the assistant's texts with end marks, in characters of the rendered turns."""
    around = len(OPEN) - len("{role}")
    lengths = F.transform(turns, lambda x: around + F.length(x[side]["role"]) + F.length(x[side]["text"]) + len(CLOSE))
    def stretch(x: Column, k: Column) -> Column:
        before = F.aggregate(F.slice(lengths, F.lit(1), k), F.lit(0), lambda a, n: a + n)
        start = before + around + F.length(x[side]["role"])
        end = before + F.element_at(lengths, k + 1)
        return F.when(x[side]["role"] == ASSISTANT, F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))

    return F.filter(F.transform(turns, stretch), lambda s: s.isNotNull())


def neighbour_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference pairs from a table of conversations: each is chosen, and rejected is the same one with its
    last turn's text taken from its neighbour's last turn (conv_id with the lowest bit flipped).

    A conversation whose neighbour is missing, or ends alike, has no difference.
    """
    c = conversations.where("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    last = c.groupBy("pair_id").agg(F.max(F.struct("turn", "role", "text")).alias("l"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("l.text").alias("other_text"))
    swap = last.select("pair_id", F.col("l.turn").alias("last_turn")).join(other, "pair_id", "left")
    swapped = F.when((F.col("turn") == F.col("last_turn")) & F.col("other_text").isNotNull(), F.col("other_text")).otherwise(F.col("text"))
    rejected = c.join(swap, "pair_id").select("pair_id", "turn", "role", swapped.alias("text"))
    return c, rejected
