"""Mixing sources to target weights, with DataFrame functions only.

Every document gets a hash-random key. Within each source documents are ordered by key; the key range
is split into equal sub-ranges so that a source of any size spreads over many tasks, sums of the
sub-ranges give distributed prefix sums of the sizes, and the source is cut at its exact budget after
as many whole epochs as the budget holds. What meets in one window is a range of keys, a range of
ranges, or the sources themselves, one row for each.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, word_count

#: Weights of the sources in order, repeating; the share of all sizes that the mix has; the most epochs of a source.
WEIGHTS, SHARE, MOST_EPOCHS = (5, 2, 1), 1.5, 2
#: Rows that a sub-range of keys holds on average.
ROWS_PER_RANGE = 256
#: Keys are the first 52 bits of an md5, so that sub-ranges divide them without rounding.
KEY_BITS = 52


def random_key(doc_id: Column, text: Column) -> Column:
    """A number of 52 bits from the md5 of the id as text, a colon and the text; nulls count as empty. So
    rows without an id, or with one id, have keys of their own unless their texts are equal too."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """Source, source_size, target from (source, source_size), one row for each source.

    Sources share share x all sizes by weight. A target stops at `most` x its source's size and the
    excess is shared again by weight until none is above. That ends where target = min(level x weight,
    bound); the level comes from prefix sums over the sources in order of bound / weight. It works on
    one row for each source, not on documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_bound", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("_ratio", F.col("_bound") / F.col("_weight"))
    whole = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before, after = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        rows.withColumn("_filled", F.coalesce(F.sum("_bound").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_weight").over(after))
        .withColumn("_all", F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_all") * F.lit(float(share)) - F.col("_filled")) / F.col("_open"))
    )
    # the first source that the level leaves below its bound sets the level of all after it
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", F.col("source").isNull().alias("none"), "source", "_level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("_at", level.getField("_level"))
    return rows.select("source", "source_size", F.when(F.col("_at").isNull(), F.col("_bound")).otherwise(F.least(F.col("_bound"), F.col("_at") * F.col("_weight"))).alias("target"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every document, and the columns of
    `carry`.

    The sum of `taken` over a source is its target rounded down. Null or empty texts have size 0 and
    take 0. A null source is a source of its own, last in order. Null and repeated ids are taken as others
    are; rows that are equal in id and text have one key and are interchangeable. No row is dropped."""
    rows = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), F.col("text")).alias("_key"), *carry)
    if not carry:  # a few numbers for each document, made once; with whole rows they are made twice rather than written
        rows = materialise(rows, "sizes")
    # as many sub-ranges as the table's rows ask for, the same on each run
    ranges = max(1, math.ceil(rows.count() / ROWS_PER_RANGE))
    name = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = rows.withColumn("_range", F.floor(F.col("_key") / F.lit(float(1 << KEY_BITS)) * F.lit(ranges)).cast("long")).withColumn("_source", name)
    part = rows.groupBy("_source", "_range").agg(F.sum("size").alias("_sum"))
    per_source = part.groupBy("_source").agg(F.sum("_sum").alias("source_size"))
    aims = targets(per_source.select(F.when(~F.col("_source.none"), F.col("_source.name")).alias("source"), "source_size"), weights, share, most)
    aims = aims.select(F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_source"), "source_size", "target")
    # prefix sums over the ranges of a source: first over groups of ranges, then inside of each, so
    # that the one source with a third of all rows isn't one task's
    group = F.floor(F.col("_range") / 1024)
    part = part.withColumn("_group", group)
    groups = part.groupBy("_source", "_group").agg(F.sum("_sum").alias("_group_sum"))
    ahead = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_ahead", F.coalesce(F.sum("_group_sum").over(ahead), F.lit(0)))
    inside = Window.partitionBy("_source", "_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("_inside", F.coalesce(F.sum("_sum").over(inside), F.lit(0))).join(groups, ["_source", "_group"]).join(aims, "_source")
    part = part.select("_source", "_range", "source_size", "target", (F.col("_ahead") + F.col("_inside")).alias("_ahead"))
    here = Window.partitionBy("_source", "_range").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(part, ["_source", "_range"]).withColumn("_before", F.col("_ahead") + F.coalesce(F.sum("size").over(here), F.lit(0)))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before")))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carry)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as it is taken; the one document of
    a source where its budget ends is cut after its last word taken.

    A document of size 0 holds nothing to take and is left out. Equal rows are interchangeable."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id"), F.col("source"), F.col("text"))
    chosen = plan(whole, carry=("_row",), **how)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), times), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    out = chosen.select("_row", F.explode(copies).alias("_rest"))
    names = docs.columns
    return out.select(*[(F.when(F.col("_rest") > 0, _cut(F.col("_row.text"), F.col("_rest"))).otherwise(F.col("_row.text")) if c == "text" else F.col(f"_row.`{c}`")).alias(c) for c in names])


def _cut(text: Column, n: Column) -> Column:
    """The text without what follows its n-th word: a walk over the words and the white space between."""
    parts = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")
