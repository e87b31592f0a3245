"""Preference formatting of conversation pairs (operator 2). DataFrame and SQL functions only.

The turns of a chosen and a rejected conversation are compared from the first on; the longest common prefix is rendered once
as the prompt, and what follows on either side as a completion. Only what an assistant says, with the mark that ends its
turn, is trained on: each completion comes with those spans (code points, ends exclusive), everything else is masked.

Turns are ordered by turn, then role and text (so repeated turn numbers have a fixed order). One shuffle on the pair; a pair
is a row of the result, so its turns meet in one task by nature. Defined results: null roles and texts count as empty; a
pair with one side has an empty prompt, that side's whole conversation as its completion, and null for the other side; if
one side is a prefix of the other, its completion is empty; rows without a pair or with another side are left out; exact
repetitions of a turn are turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the rendered form.
TURN_START, HEAD_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t.role, F.lit(HEAD_END), t.text, F.lit(TURN_END))), "")


def trained_spans(turns: Column) -> Column:
    """array<struct<start, end>> of the trained parts of a rendered completion."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        head = acc.at + F.lit(len(TURN_START) + len(HEAD_END)) + F.length(t.role)
        end = head + F.length(t.text) + F.lit(len(TURN_END))
        one = F.array(F.struct(head.alias("start"), (end - 1).alias("end")))  # without the line feed after the mark
        return F.struct(end.alias("at"), F.when(t.role == TRAINED_ROLE, F.concat(acc.spans, one)).otherwise(acc.spans).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc.spans)


def preference_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side") -> DataFrame:
    """(pair, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans) from turns with a side, chosen or rejected."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    side = lambda name: F.array_sort(F.collect_list(F.when(F.col(side_col) == name, row))).alias(name)
    pairs = turns.where(F.col(pair_col).isNotNull() & F.col(side_col).isin("chosen", "rejected")).groupBy(pair_col).agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda c, r: F.coalesce((c.role == r.role) & (c.text == r.text), F.lit(False)))
    differs = F.array_position(same, False)
    pairs = pairs.withColumn("n_common", F.when(differs == 0, F.size("chosen")).otherwise(differs - 1).cast("int"))
    rest = lambda name: F.slice(name, F.col("n_common") + 1, F.greatest(F.size(name) - F.col("n_common"), F.lit(0)))
    pairs = pairs.withColumns({"prompt": render(F.slice("chosen", 1, F.col("n_common"))), "chosen_rest": rest("chosen"), "rejected_rest": rest("rejected")})
    out = lambda name, of: F.when(F.size(name) > 0, of(F.col(f"{name}_rest")))
    return pairs.select(
        pair_col,
        "n_common",
        "prompt",
        out("chosen", render).alias("chosen_text"),
        out("rejected", render).alias("rejected_text"),
        out("chosen", trained_spans).alias("chosen_spans"),
        out("rejected", trained_spans).alias("rejected_spans"),
    )
