"""Operator 5: preference pairs as one prompt and two masked completions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqguard.llm.neighbours import with_ranges, without_ranges
from reqguard.llm.text import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"), turn["text"], F.lit(CLOSE))


def common_turns(a: Column, b: Column) -> Column:
    """How many turns both start with; turns are equal if role and text are."""
    different = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(different == 0, F.size(a)).otherwise(different - 1).cast("int")


def masked(turns: Column) -> Column:
    """Places in the rendered turns, in code points from 0, that count for the loss: assistants' texts with their end."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a, t):
        begin = a["at"] + F.length(F.concat(F.lit(OPEN), t["role"], F.lit("\n")))
        end = a["at"] + F.length(rendered(t))
        own = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(a["spans"], own)).otherwise(a["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda a: a["spans"])


def conversations_as_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, others) -> conv_id and its turns in order; nulls in role and text count as empty."""
    one = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t")).select(
        "conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def preferences(pairs: DataFrame) -> DataFrame:
    """Pairs (chosen, rejected: arrays of role and text; other columns stay) -> prompt, completions and loss masks.

    The prompt holds the longest common prefix of turns, rendered once; equal conversations leave empty completions. A
    null array counts as one without turns. Markers within a text stay as they are. Long conversations are rendered whole;
    pairs that repeat give repeated rows; an empty table gives an empty result. Columns of pairs that have the name of a
    result (prompt, prompt_turns, chosen, rejected and their masks) are replaced.
    """
    empty = F.array().cast("array<struct<role:string,text:string>>")
    p = pairs.withColumn("chosen", F.coalesce("chosen", empty)).withColumn("rejected", F.coalesce("rejected", empty))
    p = p.withColumn("prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    joined = lambda turns: F.array_join(F.transform(turns, rendered), "")
    rest = lambda side: F.expr(f"slice({side}, prompt_turns + 1, greatest(size({side}) - prompt_turns, 0))")
    return p.select(
        *[c for c in pairs.columns if c not in ("chosen", "rejected", "prompt", "prompt_turns", "chosen_mask", "rejected_mask")], "prompt_turns",
        joined(F.expr("slice(chosen, 1, prompt_turns)")).alias("prompt"),
        joined(rest("chosen")).alias("chosen"), joined(rest("rejected")).alias("rejected"),
        masked(rest("chosen")).alias("chosen_mask"), masked(rest("rejected")).alias("rejected_mask"))


def swapped_pairs(rows: DataFrame) -> DataFrame:
    """One pair per conversation: chosen as it stands; rejected with its last assistant turn replaced by that of the next
    conversation (in descending order of id, the first after the last). Without such a turn in either, both are equal.

    All turns without a conv_id are one conversation, the last. Turns of equal number are in the order of role and text.
    An empty table gives an empty result. Other columns are not read."""
    convs = conversations_as_turns(rows)
    last = F.expr("array_max(filter(transform(turns, (x, i) -> if(x.role = 'assistant', i, -1)), i -> i >= 0))")
    both, order = with_ranges(convs.withColumn("_at", last), "conv_id", [])
    reply = F.when(F.col("_at").isNotNull(), F.get("turns", F.col("_at")))
    both = both.withColumn("_reply", reply).withColumn("_other", F.lead("_reply").over(order))
    other = without_ranges(both)
    changed = F.transform("turns", lambda x, i: F.when(
        (i == F.col("_at")) & F.col("_other").isNotNull(), F.col("_other")).otherwise(x))
    return other.select("conv_id", F.col("turns").alias("chosen"), changed.alias("rejected"))
