"""Chat formatting: one example for each assistant turn, only its reply trainable.

Each turn is written as `<|turn|>role<|says|>text<|end|>`. Inside roles and
texts every control string of this or another common template gets a backslash
after its first character (one more, if it has some already), so no text can
open or close a turn and taking one backslash off gives the text back.

Prefix-target expansion explodes every assistant turn into an example: all
turns before it and its own, with the reply as the span under the loss. A
conversation is laid out in blocks of 2^BLOCK_BITS turn numbers: `expand` gives
examples with the turns of their own block, and the blocks in whole; `in_full`
puts all blocks before in front of them. Most conversations fit one block and
their examples stand alone; one with a third of all rows is spread over as many
groups as it has blocks. SQL functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.llm.common import written
from courant.session import small_side

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
# Control strings: those of the template, and those other templates read.
CONTROLS = (TURN, SAYS, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
            "<|endoftext|>")
#: Turn numbers in a block, as a power of two.
BLOCK_BITS = 5
TRAINED = "assistant"
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({_TAILS})", rf"([<\[])\\(\\*)({_TAILS})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def expand(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, block, target, text, loss_start, loss_end, whole_block), a row for each example.

    `target` is the number of the assistant turn that ends `text`; its reply
    stands at code points [loss_start, loss_end). `whole_block` marks the row of
    a block that holds all its turns. Where no example does, as the block ends
    with another role, there is a row more, without target and loss. The context
    of an example is the `whole_block` rows of all smaller blocks, in order,
    then its own text up to the reply; `in_full` puts them together.

    Turns are ordered by number (null first), then role and text; repeated rows
    all stay. Null roles and texts count as empty, a null conversation id is a
    conversation like any other. The four columns are all that is read, so other
    columns of any name do not matter. An empty table gives no row. A row of the
    result is as long as the texts of one block together.
    """
    role, said = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        role.alias("role"), said.alias("said"),
    ).withColumn("block", F.shiftright("turn", BLOCK_BITS))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "said"))).alias("t"))
    laid = blocks.select("conv_id", "block", F.transform("t", lambda t: F.struct(
        t["turn"].alias("turn"), (t["role"] == TRAINED).alias("goal"), escaped(t["said"]).alias("said"),
        F.concat(F.lit(TURN), escaped(t["role"]), F.lit(SAYS)).alias("head"),
    )).alias("t"))
    ending = F.filter(
        F.sequence(F.lit(1), F.size("t")), lambda i: F.element_at("t", i)["goal"] | (i == F.size("t"))
    )
    text = F.array_join(F.transform(
        F.slice("t", F.lit(1), F.col("i")), lambda t: F.concat(t["head"], t["said"], F.lit(END))), "")
    made = laid.select("conv_id", "block", "t", F.explode(ending).alias("i")).select(
        "conv_id", "block", F.element_at("t", F.col("i")).alias("last"), text.alias("text"),
        (F.col("i") == F.size("t")).alias("whole_block"),
    )
    end = F.length("text") - len(END)
    return made.select(
        "conv_id", "block", F.when(F.col("last.goal"), F.col("last.turn")).alias("target"), "text",
        F.when(F.col("last.goal"), end - F.length("last.said")).alias("loss_start"),
        F.when(F.col("last.goal"), end).alias("loss_end"), "whole_block",
    )


def reply(text: Column, loss_start: Column, loss_end: Column) -> Column:
    """What stands under the loss, as it was said; null without a loss."""
    return unescaped(F.substring(text, loss_start + 1, loss_end - loss_start))


def turns_of(text: Column) -> Column:
    """array<struct(role, text)> of what a formatted text holds."""
    pieces = F.split(text, re.escape(END))
    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substring(F.substring_index(p, SAYS, 1), F.lit(len(TURN) + 1), F.length(p))).alias("role"),
        unescaped(F.substring(p, F.instr(p, SAYS) + len(SAYS), F.length(p))).alias("text"),
    ))


def in_full(rows: DataFrame) -> DataFrame:
    """(conv_id, target, text, loss_start, loss_end) of the examples, each with all the turns before it.

    `rows` is what `expand` gives. Contexts are made only for conversations of
    several blocks, once for each block, and a whole example is put together in the
    row it is read from. Such a conversation grows with the square of its length,
    as every example holds what was said before.
    """
    rows = rows.withColumn("place", F.coalesce("block", F.lit(-(1 << 62))))
    long = rows.where("whole_block").groupBy(F.col("conv_id").alias("c")).agg(F.count("*").alias("n")).where("n > 1")
    blocks = written(
        rows.where("whole_block").join(small_side(written(long, "long")), F.col("conv_id").eqNullSafe(F.col("c")))
        .select("c", "place", "text"), "blocks",
    )
    earlier = blocks.select(F.col("c").alias("conv"), F.col("place").alias("earlier"), F.col("text").alias("before"))
    contexts = written(
        blocks.join(earlier, F.col("c").eqNullSafe(F.col("conv")) & (F.col("earlier") < F.col("place")))
        .groupBy("c", F.col("place").alias("of"))
        .agg(F.sort_array(F.collect_list(F.struct("earlier", "before")))["before"].alias("before"))
        .select("c", "of", F.array_join("before", "").alias("before")), "contexts",
    )
    own = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("of"))
    examples = rows.where("loss_end IS NOT NULL").join(small_side(contexts), own, "left")
    before = F.coalesce("before", F.lit(""))
    return examples.select(
        "conv_id", "target", F.concat(before, "text").alias("text"),
        (F.col("loss_start") + F.length(before)).alias("loss_start"),
        (F.col("loss_end") + F.length(before)).alias("loss_end"),
    )
