"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and all others as named users; `system` turns stay system turns for
everyone and nobody takes their place. What the assistant says is to be learned, which
a mask gives as character spans over the rendered text.

Conversations are cut into parts of PART_TURNS rows by their place in the conversation's
order, so no group grows with a conversation's length, parts are contiguous and part k
begins at row k * PART_TURNS. Every participant of the conversation has a rendering of
every part, also of those where nothing of theirs is said. Spans are relative to the
part's text.

What is said can't forge turns: in texts and names a mark's opening `<|` is written `< |`, and line ends in names
are blanks. Order is by turn (null first), speaker, text. Defined results: a null text
counts as empty and is rendered; a null speaker counts as `unknown`; rows with a null
conv_id form one conversation; repeated rows are rendered as often as they come;
conversations of system turns alone give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

PART_TURNS = 256
BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _line(turn: Column, speaker: Column) -> Column:
    head = F.when(turn["speaker"] == speaker, F.lit("assistant")).when(turn["speaker"] == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), turn["speaker"]))
    return F.concat(F.lit(BEGIN), head, F.lit("\n"))


def _parts(rows: DataFrame) -> DataFrame:
    """Adds the part by two-level ranks: places within sorted ranges, shifted by the counts of the ranges before."""
    # equal rows are interchangeable, so any tie-break that lets ranges split them gives the same parts
    order = ["conv_id", "turn", "speaker", "text", "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    placed = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "chat-turns").withColumn("range", F.shiftright("at", 33))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy(F.col("conv_id").alias("c"), F.col("range").alias("r")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    offsets = counts.select("c", "r", "first", F.coalesce(before, F.lit(0)).alias("off"))
    joined = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return joined.withColumn("part", F.floor((F.col("at") - F.col("first") + F.col("off")) / PART_TURNS).cast("long")).select("conv_id", "turn", "speaker", "text", "part")


def rotate(df: DataFrame) -> DataFrame:
    """conv_id, part, speaker, n_turns, n_masked (turns to learn), text, mask_spans.

    Input: conv_id, turn, role, text. mask_spans: array<struct<start, end>> in code points.
    """
    plain = lambda c, otherwise: F.replace(F.coalesce(c, F.lit(otherwise)), F.lit("<|"), F.lit("< |"))
    speaker = F.translate(plain("role", "unknown"), "\n\r", "  ")
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), speaker.alias("speaker"), plain("text", "").alias("text"))
    # conversations that fit one part need no ranks
    about = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(F.col("speaker") != "system", F.col("speaker")))).alias("speakers")).select(F.col("conv_id").alias("c"), "n", "speakers")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    long = about.filter(F.col("n") > PART_TURNS)
    rows = rows.join(long, same, "left_anti").withColumn("part", F.lit(0).cast("long")).unionByName(_parts(rows.join(long, same, "left_semi")))
    turns = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "speaker", "text"))).alias("turns"))
    each = turns.join(about, same).select("conv_id", "part", "turns", F.explode("speakers").alias("speaker"))
    lines = F.transform("turns", lambda t: F.struct(_line(t, F.col("speaker")).alias("head"), t["text"].alias("body"), (t["speaker"] == F.col("speaker")).alias("own")))
    each = each.withColumn("lines", lines)
    rendered = F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    size = lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def place(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["head"])
        span = F.struct(begin.alias("start"), (begin + F.length(x["body"]) + len(END.rstrip("\n"))).alias("end"))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(x["own"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("lines", start, place)["spans"]
    return each.select("conv_id", "part", "speaker", F.size("lines").cast("long").alias("n_turns"), F.size(F.filter("lines", lambda x: x["own"])).cast("long").alias("n_masked"), rendered.alias("text"), spans.alias("mask_spans"))
