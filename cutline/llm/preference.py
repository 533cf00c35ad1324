"""Preference pairs as one shared prompt and two masked completions, in DataFrame operations only.

The common prefix of a pair ends before the first turn number at which the chosen and rejected
conversations differ in role or text, or which only one of them has. That number is a
grouped minimum over a join by (pair, turn), so no conversation is gathered to find it; rendered
turns are gathered once per pair at the end, since a training example is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

CHOSEN, REJECTED = "chosen", "rejected"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED_ROLE = "assistant"
_FIRST = -(1 << 62)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def _side(turns: DataFrame, side: str) -> DataFrame:
    """One (role, text) for each turn number of one side."""
    own = turns.where(F.col("side") == side).groupBy("pair", "turn").agg(F.min(F.struct("role", "text")).alias("said"))
    return own.select("pair", "turn", F.struct("said.role", "said.text").alias(side))


def preference_examples(turns: DataFrame, pair_column: str = "pair_id") -> DataFrame:
    """(pair, n_prompt_turns, n_chosen_turns, n_rejected_turns, prompt, chosen, rejected, chosen_spans, rejected_spans).

    ``turns`` has the pair's id, ``side`` ("chosen" or "rejected"), ``turn``, ``role`` and ``text``. A
    turn is rendered between an opening line with its role and a closing mark. ``*_spans`` lists
    the stretches of a completion that count for training, as ``start-end`` in characters (end
    excluded), joined by commas: the text and closing mark of each assistant turn; all else is masked.

    Turn numbers order the turns; one missing on a side is a difference there; a null one comes first. Null role
    or text count as empty. Of several rows for one turn of a side the smallest (role, text) counts, so
    repeated rows change nothing. Equal conversations are all prompt and have empty completions; a pair with
    one side has an empty prompt and an empty other side. Rows with a null pair or another side belong to no
    pair and give nothing. Other columns are not read; an empty table gives none.
    """
    clean = turns.where(F.col(pair_column).isNotNull() & F.col("side").isin(CHOSEN, REJECTED)).select(
        F.col(pair_column).alias("pair"), "side", F.coalesce(F.col("turn").cast("bigint"), F.lit(_FIRST)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    met = _side(clean, CHOSEN).join(_side(clean, REJECTED), ["pair", "turn"], "full")
    gathered = met.groupBy("pair").agg(
        F.min(F.when(~F.col(CHOSEN).eqNullSafe(F.col(REJECTED)), F.col("turn"))).alias("split"),
        F.array_sort(F.collect_list(F.struct("turn", CHOSEN, REJECTED))).alias("all"))
    at = lambda x: F.col("split").isNull() | (x["turn"] < F.col("split"))

    def part(side: str, shared: bool) -> Column:
        own = F.filter("all", lambda x: x[side].isNotNull() & (at(x) if shared else ~at(x)))
        return F.transform(own, lambda x: x[side])

    parts = gathered.select("pair", part(CHOSEN, True).alias("p"), part(CHOSEN, False).alias("c"), part(REJECTED, False).alias("r"))

    def joined(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: rendered(x["role"], x["text"])), "")

    def spans(name: str) -> Column:
        step = lambda s, x: F.struct(
            (s["end"] + F.length(rendered(x["role"], x["text"]))).cast("bigint").alias("end"),
            F.when(x["role"] == TRAINED_ROLE, F.concat(s["found"], F.array(F.concat_ws(
                "-", s["end"] + F.length(F.concat(F.lit(OPEN), x["role"], F.lit("\n"))), s["end"] + F.length(rendered(x["role"], x["text"]))))))
            .otherwise(s["found"]).alias("found"))
        start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("found"))
        return F.array_join(F.aggregate(name, start, step)["found"], ",")

    size = lambda c: F.size(c).cast("bigint")
    return parts.select(
        F.col("pair").alias(pair_column), size("p").alias("n_prompt_turns"), size("c").alias("n_chosen_turns"), size("r").alias("n_rejected_turns"),
        joined("p").alias("prompt"), joined("c").alias("chosen"), joined("r").alias("rejected"),
        spans("c").alias("chosen_spans"), spans("r").alias("rejected_spans"))


def with_foreign_answers(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations (conv_id, turn, role, text), one for each.

    Chosen is the conversation; rejected is the same with its last assistant turn replaced by the
    last one of the conversation with the next id, or left out where that has none.
    """
    last = conversations.where(F.col("role") == TRAINED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    answers = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("last.text").alias("answer"))
    told = conversations.select("conv_id", "turn", "role", "text").join(
        last.select("conv_id", F.col("last.turn").alias("last_turn")), "conv_id", "left").join(answers, "conv_id", "left")
    final = (F.col("turn") == F.col("last_turn")) & (F.col("role") == TRAINED_ROLE)
    final = F.coalesce(final, F.lit(False))
    rejected = told.where(~final | F.col("answer").isNotNull()).select(
        F.col("conv_id").alias("pair_id"), F.lit(REJECTED).alias("side"), "turn", "role", F.when(final, F.col("answer")).otherwise(F.col("text")).alias("text"))
    chosen = conversations.select(F.col("conv_id").alias("pair_id"), F.lit(CHOSEN).alias("side"), "turn", "role", "text")
    return chosen.unionByName(rejected)
