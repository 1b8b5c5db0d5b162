"""Multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant, the others
as users with their names, and narrators' turns (system) as they are. Masks are code point spans of the speaker's own
words. Offsets are running sums over the dialogue, taken once for all its speakers: seen by another speaker, each own
turn before shifts what follows by the same difference of two heads. Sums and rendering need one shuffle, by
conversation, and time in proportion to the turns.

A rendering is one value, so a dialogue has to fit into a row. rotated_turns gives the same renderings turn by turn,
for conversations of any length: nothing there is gathered, and a conversation is dealt out by speaker.

Turns are ordered by turn (nulls first), speaker, text; equal rows stay. A null speaker is called "unknown"; null text
is empty; null conversations are one conversation. A conversation without participants gives no perspective. Other
columns of the input are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Roles that are not participants.
NARRATORS = ("system",)
OWN, END = "<|assistant|>\n", "\n<|end|>\n"
ORDER = ("turn", "speaker", "text")


def _other(name: Column, narrators: tuple[str, ...]) -> Column:
    """The head of a turn that isn't the perspective's own."""
    return F.when(name.isin(*narrators), F.concat(F.lit("<|"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def _turns(turns: DataFrame, conv: str, turn: str, speaker: str, text: str) -> DataFrame:
    return turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, speaker, n_turns, n_own, text, spans (array of start, end): a row per conversation and participant."""
    rows = _turns(turns, conv, turn, speaker, text)
    before = Window.partitionBy("conv_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(_other(F.col("speaker"), narrators)) + F.length("text") + len(END)
    rows = rows.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")))
    who = F.collect_set(F.when(~F.col("speaker").isin(*narrators), F.col("speaker")))
    dialogue = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*ORDER, "at"))).alias("turns"), who.alias("who"))
    each = dialogue.select("conv_id", "turns", F.explode("who").alias("speaker")).withColumn("own", F.filter("turns", lambda t: t["speaker"] == F.col("speaker")))
    shift = len(OWN) - F.length(_other(F.col("speaker"), narrators))

    def span(t: Column, k: Column) -> Column:
        start = t["at"] + k * shift + len(OWN)
        return F.struct(start.alias("start"), (start + F.length(t["text"])).alias("end"))

    def piece(t: Column) -> Column:
        return F.concat(F.when(t["speaker"] == F.col("speaker"), F.lit(OWN)).otherwise(_other(t["speaker"], narrators)), t["text"], F.lit(END))

    return each.select(
        "conv_id", "speaker", F.size("turns").cast("long").alias("n_turns"), F.size("own").cast("long").alias("n_own"),
        F.array_join(F.transform("turns", piece), "").alias("text"), F.transform("own", span).alias("spans"),
    )


def rotated_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", narrators: tuple[str, ...] = NARRATORS) -> DataFrame:
    """conv_id, speaker, position, text (the turn's piece of the rendering), start, end (null unless the turn is the speaker's own)."""
    rows = _turns(turns, conv, turn, speaker, text)
    who = rows.where(~F.col("speaker").isin(*narrators)).select(F.col("conv_id").alias("c"), F.col("speaker").alias("me")).distinct()
    each = rows.join(who, F.col("conv_id").eqNullSafe(F.col("c")))
    own = F.col("speaker") == F.col("me")
    head = F.when(own, F.lit(OWN)).otherwise(_other(F.col("speaker"), narrators))
    order = Window.partitionBy("conv_id", "me").orderBy(*ORDER)
    size = F.length(head) + F.length("text") + len(END)
    start = F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(END) - F.length("text")
    return each.select(
        "conv_id", F.col("me").alias("speaker"), F.row_number().over(order).cast("long").alias("position"), F.concat(head, "text", F.lit(END)).alias("text"),
        F.when(own, start).alias("start"), F.when(own, start + F.length("text")).alias("end"),
    )
