"""Chat formatting by multi-party perspective rotation.

For every participant of a dialogue, the whole dialogue is rendered with that
speaker as the assistant, the others as named users, and narrators (system) as they
are. A rendering is one row for each turn, with its place among the characters of
the rendered dialogue and the mask of what is learned: the assistant's text and its
end mark. Concatenating ``rendered`` by ``position`` gives the dialogue.

Places are sums over turn blocks: the characters of each block and speaker are
counted first, which is enough to know where every block starts for every
perspective. A dialogue that holds a third of all rows is so dealt over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a block.
BLOCK = 256
END = "<|end|>\n"
#: What stands before a name inside this module, so that no name is the empty one of a null speaker.
NAMED = "="


def escaped(text: Column) -> Column:
    """The text with a backslash more in every opening of a mark, escaped or not, so that it holds no mark and can be had back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def _header(speaker: Column, perspective: Column, narrators: Sequence[str]) -> Column:
    name = F.regexp_replace(escaped(F.substr(speaker, F.lit(len(NAMED) + 1))), r"[\r\n]", " ")
    return (
        F.when(speaker == perspective, "<|assistant|>\n")
        .when(speaker == "", "<|user|>\n")
        .when(speaker.isin(*(NAMED + n for n in narrators)), F.concat(F.lit("<|"), name, F.lit("|>\n")))
        .otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    )


def rotate_perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    narrators: Sequence[str] = ("system",),
) -> DataFrame:
    """One row per (dialogue, participant, turn): ``conv``, ``perspective``, ``position``, ``turn``, ``speaker``, ``rendered``, ``start``, ``stop``, ``mask_start``, ``mask_stop``.

    ``start`` and ``stop`` are code points of the rendered dialogue; the mask is null
    where nothing is learned. Turns go by number (null first), then speaker (null
    first), then text; repeated rows all stay. A null speaker is a participant of its
    own, without name; a null text is empty, rows with a null dialogue form one
    dialogue. Whatever opens a mark in a text or a name is escaped (see ``escaped``), and
    places count the escaped text; very long texts are whole. A dialogue of narrators
    alone has no participant and no rows. An empty table gives none; other columns are
    not read. By design there is a row for each participant and turn.
    """
    rows = turns.select(
        F.col(conv).alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.concat(F.lit(NAMED), F.col(speaker).cast("string")), F.lit("")).alias("speaker"),
        escaped(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    ).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))))
    counts = rows.groupBy("conv", "block", "speaker").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text") + len(END)).alias("chars")
    )
    people = counts.where(~F.col("speaker").isin(*(NAMED + n for n in narrators))).select(F.col("conv").alias("of"), F.col("speaker").alias("perspective")).distinct()
    header = F.char_length(_header(F.col("speaker"), F.col("perspective"), narrators))
    blocks = (
        counts.join(people, counts.conv.eqNullSafe(people.of))
        .groupBy("conv", "perspective", "block")
        .agg(F.sum("n").alias("n"), F.sum(F.col("chars") + F.col("n") * header).alias("chars"))
    )
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv").alias("of"),
        F.col("block").alias("in_block"),
        "perspective",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
    )
    placed = rows.join(blocks, rows.conv.eqNullSafe(blocks.of) & (rows.block == blocks.in_block))
    head = _header(F.col("speaker"), F.col("perspective"), narrators)
    placed = placed.withColumn("rendered", F.concat(head, "text", F.lit(END)))
    inside = Window.partitionBy("conv", "perspective", "block").orderBy(F.asc_nulls_first("turn"), "speaker", "text")
    stop = F.col("chars_before") + F.sum(F.char_length("rendered")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumns({"position": F.col("turns_before") + F.row_number().over(inside) - 1, "stop": stop})
    learned = F.col("speaker") == F.col("perspective")

    def name(column: str) -> Column:
        return F.when(F.col(column) != "", F.substr(F.col(column), F.lit(len(NAMED) + 1)))

    return out.select(
        F.col("conv").alias(conv),
        name("perspective").alias("perspective"),
        "position",
        F.col("turn").alias(turn),
        name("speaker").alias(speaker),
        "rendered",
        (F.col("stop") - F.char_length("rendered")).alias("start"),
        "stop",
        F.when(learned, F.col("stop") - F.char_length("text") - len(END)).alias("mask_start"),
        F.when(learned, F.col("stop")).alias("mask_stop"),
    )
