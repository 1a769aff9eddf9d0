"""Exact distinct counts as state that can be stored and merged: who was there, per key and bucket of ids.

Ids are whole numbers. An id belongs to a bucket of 32,768 neighbouring ids and has a position in it. The
state has a row per key and bucket that occurs: a bucket with few ids lists their positions (two bytes each),
a fuller one holds a bitmap (4 KB). So a store with some of a billion customers takes no more room than a
list of them, and a store with all of them an eighth of a byte each. Unions of states give the exact count
of any set of months or stores without the lines.

A missing id is a member of its own, as in ``n_unique``: a row without a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.session import spread

#: Most ids of a bucket that are listed; a list of more would be no smaller than the bitmap.
LISTED = 2048


def _with_bits(bitmap: Column, positions: Column) -> Column:
    """The bitmap (none: empty) with the bits of the ascending positions set; its eight-byte words pass as hex digits.

    Laid out as by ``bitmap_construct_agg``: bit ``p % 8`` of byte ``p // 8``, 4,096 bytes.
    """
    base = F.coalesce(F.hex(bitmap), F.repeat(F.lit("0"), F.lit(8192)))

    def stored(word: Column) -> Column:
        return F.conv(F.substring(base, word * 16 + 1, F.lit(16)), 16, -10).cast("bigint")

    def digits(bits: Column) -> Column:
        return F.lpad(F.hex(bits), 16, "0")

    def put(done: Column, position: Column) -> Column:
        p = position.cast("int")
        word = F.shiftright(p, 6)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), 56 - F.shiftright(p % 64, 3) * 8 + p % 8)
        same = word == done["word"]
        between = F.substring(base, (done["word"] + 1) * 16 + 1, (word - done["word"] - 1) * 16)
        begun = F.when(done["word"] < 0, between).otherwise(F.concat(done["text"], digits(done["bits"]), between))
        return F.struct(
            F.when(same, done["text"]).otherwise(begun).alias("text"),
            word.alias("word"),
            F.when(same, done["bits"]).otherwise(stored(word)).bitwiseOR(bit).alias("bits"),
        )

    def whole(done: Column) -> Column:
        rest = F.substring(base, (done["word"] + 1) * 16 + 1, F.lit(8192))
        return F.unhex(F.when(done["word"] < 0, rest).otherwise(F.concat(done["text"], digits(done["bits"]), rest)))

    nothing = F.struct(F.lit("").alias("text"), F.lit(-1).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    return F.aggregate(positions, nothing, put, whole)


def _held(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows (by, bucket, position, bitmap), of which either is null, as one row per bucket; at most one has a bitmap.

    Thin buckets list their positions. Only a fuller one, or one that has a bitmap, gets a bitmap: most
    states have very many thin buckets, and 4 KB for each would outweigh their ids a hundred times.
    """
    held = points.groupBy(*by, "bucket").agg(
        F.sort_array(F.collect_set("position")).alias("positions"),  # a bucket has 32,768 positions at most
        F.max("bitmap").alias("bitmap"),
    )
    known, full = F.col("bucket").isNotNull(), F.col("bitmap").isNotNull() | (F.size("positions") > LISTED)
    return held.select(
        *by,
        "bucket",
        F.when(known & ~full, F.col("positions")).alias("positions"),
        F.when(known & full, _with_bits(F.col("bitmap"), F.col("positions"))).alias("bitmap"),
    )


def member_state(df: DataFrame, by: Sequence[str], ids: str) -> DataFrame:
    """The state of the column ``ids`` per ``by``: by, bucket, positions (smallint array), bitmap.

    The rows are dealt out by key and bucket, so a key with a third of the rows is spread over the tasks by its
    buckets, and a task lists only the buckets of its share.
    """
    c = F.col(ids).cast("bigint")
    points = df.select(
        *by,
        F.bitmap_bucket_number(c).alias("bucket"),
        F.bitmap_bit_position(c).cast("smallint").alias("position"),
        F.lit(None).cast("binary").alias("bitmap"),
    )
    return _held(spread(points, *by, "bucket"), by)


def merge_members(state: DataFrame, by: Sequence[str]) -> DataFrame:
    """The union of states over everything but ``by``; again a state.

    Listed positions are merged as rows, spread by key and id, bitmaps as they are; both meet in buckets that
    have some of each.
    """
    listed = state.filter("bitmap IS NULL AND bucket IS NOT NULL")
    points = listed.select(*by, "bucket", F.explode("positions").alias("position"))
    full = state.filter("bitmap IS NOT NULL").groupBy(*by, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    none = F.lit(None).cast("smallint").alias("position")
    ids = spread(points, *by, "bucket", "position").distinct().withColumn("bitmap", F.lit(None).cast("binary"))
    return _held(ids.unionByName(full.select(*by, "bucket", none, "bitmap")), by).unionByName(_missing(state, by))


def _missing(state: DataFrame, by: Sequence[str]) -> DataFrame:
    return (
        state.filter("bucket IS NULL")
        .select(
            *by,
            "bucket",
            F.lit(None).cast("array<smallint>").alias("positions"),
            F.lit(None).cast("binary").alias("bitmap"),
        )
        .distinct()
    )


def count_members(state: DataFrame, by: Sequence[str], name: str = "members") -> DataFrame:
    """Distinct ids per ``by`` of a state that has one row per ``by`` and bucket."""
    listed, full = F.size("positions"), F.bitmap_count("bitmap")
    each = F.when(F.col("bucket").isNull(), 1).when(F.col("bitmap").isNull(), listed).otherwise(full)
    return state.groupBy(*by).agg(F.sum(each.cast("bigint")).alias(name))


def distinct_over(state: DataFrame, by: Sequence[str], name: str = "members") -> DataFrame:
    """Distinct ids per ``by`` of any state, whatever else it is keyed by."""
    return count_members(merge_members(state, by), by, name)
