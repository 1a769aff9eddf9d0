"""Row numbers and histograms that never gather a column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.values import known_number
from basketry.session import stage

def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add row numbers 1..n in the given total order without a single-task window.

    The rows are range-partitioned and written once; a row's number is its place in its
    partition plus the sizes of the partitions before.
    """
    ranged = df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id())
    table = stage(ranged)
    sizes = table.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_size"))
    # One row per written partition.
    running = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_chunk", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy("_chunk").orderBy(*order))
    return (
        table.withColumn("_place", place)
        .join(offsets, "_chunk")
        .select(*df.columns, (F.col("_before") + F.col("_place")).alias(name))
    )


def histogram(
    df: DataFrame, value: str, bins: int, by: str | None = None, weight: str | None = None
) -> DataFrame:
    """Counts in ``bins`` right-closed bins whose first is centred on the minimum.

    The bin width is (max - min) / (bins - 1) over all rows, also with groups; empty bins
    are listed with 0; missing values and NaN are left out. Equal values are merged first, in the
    tasks and then by one shuffle; range and bins are both taken from the merged values, so the
    input is read once. ``weight`` holds the number of rows where equal rows were merged before.
    """
    if bins < 2:
        raise ValueError("a histogram needs at least two bins")
    groups = [by] if by else []
    rows = F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")
    merged = (
        df.select(*groups, known_number(value).alias("value"), rows.alias("rows"))
        .filter(F.col("value").isNotNull())
        .groupBy(*groups, "value")
        .agg(F.sum("rows").alias("rows"))
    )
    span = merged.agg(
        F.struct(
            F.min("value").alias("lo"),
            ((F.max("value") - F.min("value")) / (bins - 1)).alias("width"),
            # The rows are read here too, so that both uses share one shuffle.
            F.sum("rows").alias("rows"),
        )
    )
    spanned = merged.withColumn("span", span.scalar())
    # A single distinct value has width 0: all rows go to bin 0.
    steps = F.try_divide(F.col("value") - F.col("span.lo"), F.col("span.width")) - 0.5
    index = F.greatest(F.coalesce(F.ceil(steps), F.lit(0)), F.lit(0)).cast("int")
    binned = spanned.groupBy(*groups, index.alias("bin")).agg(F.sum("rows").alias("count"))
    # At most ``bins`` entries per group are gathered here.
    present = (
        binned.groupBy(*groups)
        .agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("filled"))
        .withColumn("span", span.scalar())
        .filter(F.size("filled") > 0)
    )
    last = F.when(F.col("span.width") > 0, bins - 1).otherwise(0)
    listed = present.select(
        *groups, "span", "filled", F.explode(F.sequence(F.lit(0), last)).alias("bin")
    )
    return listed.select(
        *groups,
        "bin",
        (F.col("span.lo") + (F.col("bin") - 0.5) * F.col("span.width")).alias("lower"),
        (F.col("span.lo") + (F.col("bin") + 0.5) * F.col("span.width")).alias("upper"),
        F.coalesce(F.try_element_at("filled", F.col("bin")), F.lit(0)).alias("count"),
    )
