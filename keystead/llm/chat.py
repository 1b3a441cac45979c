"""Chat formatting: perspective rotation of dialogues with several parties, with DataFrame functions only.

For every participant the dialogue is rendered with that speaker as the assistant and the others as
named users; spans say which characters the assistant wrote. A dialogue is one text, or, where the caller
asks for parts, one text for each so many turns: then neither a row nor a task holds a whole dialogue, and
the texts of the parts, in order, are the dialogue.

Texts and names can't forge a turn: a `<` and a `|`, with nothing or only backslashes between them, get one
backslash more between them, which unescaped() takes away again; control characters and line breaks of a
name become a blank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialise

#: Roles that take no part: they are rendered under their own name from every perspective.
PASSIVE = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What a name can't hold.
BREAKS = r"[\x00-\x1F\x7F\x{85}\x{2028}\x{2029}]+"


def escaped(text: Column) -> Column:
    """The text without the beginning of a mark."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    """What escaped() made the text from."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _head(role: Column, perspective: Column, passive: tuple[str, ...]) -> Column:
    """What stands ahead of a turn's text."""
    shown = escaped(F.regexp_replace(role, BREAKS, " "))
    name = (
        F.when(role.isNull(), F.lit("user"))
        .when(role == perspective, F.lit("assistant"))
        .when(role.isin(*passive) if passive else F.lit(False), shown)
        .otherwise(F.concat(F.lit("user name="), shown))
    )
    return F.concat(F.lit(OPEN), name, F.lit("\n"))


def _numbered(rows: DataFrame, part_turns: int) -> tuple[DataFrame, DataFrame]:
    """rows with place, which orders the turns of a conversation, and part; and the number of parts of each
    conversation.

    Rows are dealt out by range of their order, so that a dialogue of any size, and turns with one number
    or none, spread over tasks; a turn's rank is its place in its range and the dialogue's turns in the
    ranges before, of which there is one number for each range and dialogue."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text"), F.col("k")]
    held = rows.withColumn("k", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    held = materialise(held.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("place")), "turns")
    held = held.withColumn("range", F.shiftright("place", 33))
    edges = held.groupBy("conv_id", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    parts = edges.groupBy("conv_id").agg(F.ceil(F.sum("n") / part_turns).cast("long").alias("parts"))
    edges = edges.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.col("place") - F.col("first") + F.col("ahead")
    return held.join(edges, ["conv_id", "range"]).select("conv_id", F.floor(rank / part_turns).cast("long").alias("part"), "place", "role", "text"), parts


def rotate(turns: DataFrame, passive: tuple[str, ...] = PASSIVE, part_turns: int | None = None) -> DataFrame:
    """conv_id, perspective, part, text, spans, n_turns, n_own: one row for each conversation and each of
    its participants, and if part_turns is given, for each part of so many turns.

    Turns are in order of (turn, role, text), null turns last, null roles first; repeated rows are rendered
    as often as they occur. part counts from 0. spans is an array of (start, end) in code points of the
    row's text, end not included: the assistant's texts with the mark that closes them. A null text is
    empty; a null role is an unnamed user and no participant. Rows without a conv_id belong to no
    dialogue; a dialogue with passive roles only has no perspective. Texts of any length are rendered
    whole. Other columns are ignored."""
    rows = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    speakers = rows.where(F.col("role").isNotNull() & ~(F.col("role").isin(*passive) if passive else F.lit(False)))
    speakers = speakers.select("conv_id", F.col("role").alias("perspective")).distinct()
    if part_turns is None:
        numbered = rows.select("conv_id", F.lit(0).cast("long").alias("part"), F.struct(F.col("turn").isNull().alias("last"), "turn").alias("place"), "role", "text")
        views = speakers.withColumn("part", F.lit(0).cast("long"))
    else:
        numbered, parts = _numbered(rows, part_turns)
        views = speakers.join(parts, "conv_id").select("conv_id", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    # perspectives meet the numbers of the parts, then each part its texts: one dialogue isn't one task's
    texts = numbered.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    both = texts.join(views, ["conv_id", "part"])
    me = F.col("perspective")

    def segment(t: Column) -> Column:
        head = _head(t["role"], me, passive)
        own = F.coalesce(t["role"] == me, F.lit(False))
        return F.struct(F.concat(head, escaped(t["text"]), F.lit(CLOSE)).alias("s"), F.char_length(head).alias("h"), own.alias("own"))

    def render(segments: Column) -> Column:
        begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

        def step(a: Column, x: Column) -> Column:
            end = a["at"] + F.char_length(x["s"])
            span = F.struct((a["at"] + x["h"]).cast("long").alias("start"), (end - 1).cast("long").alias("end"))
            return F.struct(end.cast("long").alias("at"), F.when(x["own"], F.concat(a["spans"], F.array(span))).otherwise(a["spans"]).alias("spans"))

        return F.struct(F.array_join(F.transform(segments, lambda x: x["s"]), "").alias("text"), F.aggregate(segments, begin, step, lambda a: a["spans"]).alias("spans"), F.size(segments).cast("long").alias("n_turns"))

    out = both.select("conv_id", "perspective", "part", let(F.transform("turns", segment), render).alias("r"))
    return out.select("conv_id", "perspective", "part", "r.text", "r.spans", "r.n_turns", F.size("r.spans").cast("long").alias("n_own"))
