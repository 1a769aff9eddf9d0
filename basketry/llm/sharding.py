"""Shards that all have the corpus mixture: proportional stratified interleaving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import running_totals


def interleave(
    docs: DataFrame, shards: int = 8, seed: str = "shards", carry: Sequence[str] = ()
) -> DataFrame:
    """Deal rows into ``shards`` equal runs, each with every source in proportion.

    Rows are shuffled within their source by a keyed hash of ``doc_id``; row r of a source with n
    rows has the fractional rank (2r + 1) / 2n. Sorted by that rank, any run of rows holds the
    sources in proportion, so the sorted rows are cut into runs whose lengths differ by one at most.

    Returns doc_id, source, the columns in ``carry``, ``shard`` (0 to shards - 1) and ``slot``, the
    place in the shard, without gaps. Null is a source. Equal doc_ids are told apart by the carried
    columns and otherwise interchangeable. With fewer rows than shards some shards stay empty; no
    rows give no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    taken = [c for c in carry if c not in ("doc_id", "source", "shard", "slot")]
    order = ["_hash", "doc_id", *taken]
    rows = docs.select(
        "doc_id",
        "source",
        *taken,
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_hash"),
        F.lit(1).cast("long").alias("_one"),
    )
    ranked = running_totals(rows, order, ["_one"], by=["source"]).withColumnRenamed("_one_before", "_rank")
    sizes = docs.groupBy(F.col("source").alias("_source")).agg(F.count(F.lit(1)).alias("_n"))
    fraction = ranked.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_fraction", (F.col("_rank") * 2 + 1).cast("double") / (F.col("_n") * 2).cast("double")
    )
    placed = running_totals(
        fraction.drop("_source", "_rank", "_n"), ["_fraction", *order, "source"], ["_one"]
    ).withColumnRenamed("_one_before", "_place")
    total = docs.agg(F.count(F.lit(1))).scalar()
    shard = f"(_place * {shards}) div _total"
    return placed.withColumn("_total", total).select(
        "doc_id",
        "source",
        *taken,
        F.expr(shard).cast("int").alias("shard"),
        (F.col("_place") - F.expr(f"(({shard}) * _total + {shards - 1}) div {shards}")).alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: str = "shards") -> None:
    """Write whole rows to one folder per shard, in slot order within its files."""
    rows = interleave(docs, shards, seed, carry=docs.columns)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)


def op9_stratified_interleaving(spark, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of all documents, with law ``rows``: counts differ by one at most."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return interleave(docs, 8, carry=["size", "text_crc32"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )


OP9_SQL = """
WITH crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([CAST(i AS UBIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))
), bytes AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS UBIGINT)) AS b
  FROM documents
), rows AS (
  SELECT doc_id, source, CAST(size AS BIGINT) AS size, md5('shards:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])),
                  4294967295::UBIGINT) AS BIGINT) AS text_crc32
  FROM bytes, crc_table
), ranked AS (
  SELECT *, (2 * (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1) + 1)::DOUBLE
            / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS fraction,
         count(*) OVER () AS total
  FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, h, doc_id, size, text_crc32, source) - 1 AS place FROM ranked
)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(place * 8 // total AS INTEGER) AS shard,
       CAST(place - (place * 8 // total * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""
