"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import parts_for, stage


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """Label every node of ``edges`` (u, v; any order, repeats allowed) with the smallest node it reaches.

    Each round first ties the larger neighbours of a node to its smallest neighbour, then the smaller
    ones; the rounds end when the edges no longer change, which is when they are stars around the
    smallest nodes. Neighbours are never gathered: a round is a minimum per node, combined in the
    tasks, staged, and joined back, so a node with very many neighbours can be split by adaptive
    execution. Edges to itself and null ends count for nothing. Returns node, label; staged.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = stage(pairs)
    parts = parts_for(stars.count())
    state = None
    while True:
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stage(least.coalesce(parts))
        large = stage(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = _digest(stars)
        if now == state:
            break
        state = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    labels = stars.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)
    return stage(labels.coalesce(parts))
