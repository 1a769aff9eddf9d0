"""The enriched hand-off laid out for its reader: bucketed by store and month, kept by month, checked as it is written."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from basketry.functions.dates import yearmonth
from basketry.functions.values import is_missing, known_number
from basketry.operators.members import count_members, distinct_over, member_state
from basketry.operators.stores import measures_of_sums
from basketry.session import stage, staging_path

KEY = ("STORE_NBR", "YEARMONTH")

#: Rows of a bucket, about: whoever reads it groups them in one task.
BUCKET_ROWS = 500_000

# --- bucketed by store and month ----------------------------------------------------------


def buckets_for(rows: int, least: int) -> int:
    """Buckets for so many rows: at least ``least``, and so many that a bucket's size doesn't grow with the table."""
    return max(least, -(-rows // BUCKET_ROWS))


def write_bucketed(enriched: DataFrame, table: str, buckets: int = 64, folder: str | None = None) -> None:
    """Write the enriched rows as a table bucketed by store and month, a file per bucket, sorted within.

    The buckets are those of Spark's own hash exchange, so whatever groups or joins by store and month, or
    by these and more columns, reads the table without moving a row. A store that holds a third of all
    rows is spread over the buckets of its months. Rows without store or date raise. A task reads a bucket
    whole, so their number should follow the rows (``buckets_for``).
    """
    path = staging_path(enriched.sparkSession, folder)
    known = F.col("STORE_NBR").isNotNull() & F.col("DATE").isNotNull()
    month = F.when(known, yearmonth(F.col("DATE"))).otherwise(F.raise_error(F.lit("a row has no store or date")))
    rows = enriched.drop("YEARMONTH").withColumn("YEARMONTH", month)
    writer = rows.repartition(buckets, *KEY).write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *KEY).sortBy(*KEY).saveAsTable(table)


# --- kept by month, with the state of each month ------------------------------------------


@dataclass(frozen=True)
class MonthlyHandoff:
    """A folder with the lines of every month, what each month adds up to, and a manifest of the months.

    ``lines``: the enriched rows. ``sums``: totals per store. ``members``: the distinct customers (kind
    ``cards``) and transactions (``baskets``) per store as mergeable state. All are partitioned by month.
    ``manifest`` is a log with the number of rows and a fingerprint of each month that changed; it is
    written last, so an update that was cut short is simply done again.
    """

    spark: SparkSession
    folder: str

    def _path(self, part: str) -> str:
        return f"{self.folder.rstrip('/')}/{part}"

    def _write(self, df: DataFrame, part: str) -> None:
        """Replace the partitions of the months in ``df``; the others are left alone."""
        rows = df.hint("rebalance", "YEARMONTH").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        rows.partitionBy("YEARMONTH").parquet(self._path(part))

    def manifest(self) -> DataFrame:
        """The latest state of every month: YEARMONTH, n, fingerprint, version; empty before the first update."""
        schema = "YEARMONTH int, n bigint, fingerprint decimal(38,0), version int"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path("manifest"))
        if not path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
            return self.spark.createDataFrame([], schema)
        log = self.spark.read.schema(schema).parquet(self._path("manifest"))
        latest = F.max_by(F.struct("n", "fingerprint", "version"), "version").alias("latest")
        return log.groupBy("YEARMONTH").agg(latest).select("YEARMONTH", "latest.*")

    def update(self, enriched: DataFrame, months: Iterable[int] = ()) -> list[int]:
        """Take in the lines of some months, each whole; returns the months that changed.

        Months whose rows equal those that are kept (in any order) stay untouched, so a repeated delivery
        changes nothing. ``months`` names those that the delivery covers besides the ones it has
        rows of: a named month without rows becomes empty. Only the lines of changed months are read again.
        """
        dated = enriched.drop("YEARMONTH").withColumn("YEARMONTH", yearmonth(F.col("DATE")))
        fields = sorted(set(dated.columns) - {"YEARMONTH"})
        incoming = stage(dated, self._path("incoming"))
        # The sum of row hashes does not depend on the order of the rows and tells repeated rows.
        delivered = incoming.groupBy("YEARMONTH").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*fields).cast("decimal(38,0)")).alias("fingerprint")
        )
        named = self.spark.createDataFrame([(m,) for m in months], "YEARMONTH int")
        covered = delivered.unionByName(
            named.join(delivered, "YEARMONTH", "left_anti").select(
                "YEARMONTH", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("decimal(38,0)").alias("fingerprint")
            )
        )
        kept = self.manifest()
        version = (kept.agg(F.max("version")).first()[0] or 0) + 1
        same = kept.withColumnsRenamed({"YEARMONTH": "_m", "n": "_n", "fingerprint": "_f"})
        equal = (
            F.col("YEARMONTH").eqNullSafe(F.col("_m")) & (F.col("n") == F.col("_n")) & (F.col("fingerprint") == F.col("_f"))
        )
        changed = stage(covered.join(same, equal, "left_anti"), self._path("incoming"))
        touched = [r.YEARMONTH for r in changed.select("YEARMONTH").collect()]  # a row per month
        if any(m is None for m in touched):
            raise ValueError("a row has no date")
        if touched:
            rows = incoming.filter(F.col("YEARMONTH").isin(touched))
            self._write(rows, "lines")
            for part, state in self._states(self.spark.read.schema(rows.schema).parquet(self._path("lines")), touched).items():
                self._write(state, part)
            changed.withColumn("version", F.lit(version)).coalesce(1).write.mode("append").parquet(self._path("manifest"))
        return sorted(touched)

    def _states(self, lines: DataFrame, touched: list[int]) -> dict[str, DataFrame]:
        some = lines.filter(F.col("YEARMONTH").isin(touched))
        sums = some.groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("lines"),
            F.sum(known_number("TOT_SALES")).alias("totSales"),
            F.sum(known_number("PROD_QTY")).alias("units"),
        )
        members = [
            member_state(some, KEY, ids).withColumn("kind", F.lit(kind))
            for kind, ids in (("cards", "LYLTY_CARD_NBR"), ("baskets", "TXN_ID"))
        ]
        return {"sums": sums, "members": members[0].unionByName(members[1])}

    def _kept(self, part: str, schema: str, months: Iterable[int] | None) -> DataFrame:
        kept = self.spark.read.schema(f"{schema}, YEARMONTH int").parquet(self._path(part))
        if months is not None:
            kept = kept.filter(F.col("YEARMONTH").isin(list(months)))
        empty = self.manifest().filter("n = 0").select("YEARMONTH")
        return kept.join(empty, "YEARMONTH", "left_anti")

    def sums(self, months: Iterable[int] | None = None) -> DataFrame:
        return self._kept("sums", "STORE_NBR bigint, lines bigint, totSales double, units double", months)

    def members(self, kind: str, months: Iterable[int] | None = None) -> DataFrame:
        """The state of ``cards`` or ``baskets`` per store and month; a month filter prunes folders."""
        schema = "STORE_NBR bigint, bucket bigint, positions array<smallint>, bitmap binary, kind string"
        return self._kept("members", schema, months).filter(F.col("kind") == kind).drop("kind")

    def measures(self, months: Iterable[int] | None = None) -> DataFrame:
        """The measures of every store and month, from the kept state alone."""
        months = None if months is None else list(months)
        found = self.sums(months)
        for kind, name in (("cards", "nCustomers"), ("baskets", "txns")):
            counted = count_members(self.members(kind, months), KEY, name).withColumnsRenamed({k: f"_{k}" for k in KEY})
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEY]
            found = found.join(counted, same[0] & same[1]).drop(*[f"_{k}" for k in KEY])
        return measures_of_sums(found)

    def customers(self, months: Iterable[int] | None = None) -> DataFrame:
        """Distinct customers per store over all given months together, without the lines."""
        return distinct_over(self.members("cards", months), ["STORE_NBR"], "nCustomers")


# --- checked as it is written -------------------------------------------------------------


def _days(date: Column) -> tuple[Column, Column]:
    """Exact number of days as a bitmap over the days since 1970 (32,768 of them, to 2059), and whether all fit."""
    day = F.unix_date(date)
    bits = F.bitmap_construct_agg(F.when(day.between(0, 32_767), day.cast("bigint")))
    return bits, F.count_if(~day.between(0, 32_767))


def write_checked(rows: DataFrame, path: str, excluded: str, matched: str = "LIFESTAGE") -> dict[str, object]:
    """Write rows by month, and take all checks of the table from the same job.

    Returns the number of rows, missing values per column (``null_<column>``), first and last day, days
    with rows, rows of the excluded product, and rows without a customer (``matched`` missing, or
    the column of that name). The metrics are observed in the tasks that write the files: no further job reads
    anything, and as these are the last tasks of the job, a repeated one counts once.
    """
    bits, outside = _days(F.col("DATE"))
    checks = Observation()
    keyed = rows.withColumn("YEARMONTH", yearmonth(F.col("DATE"))).hint("rebalance", "YEARMONTH")
    seen = keyed.observe(
        checks,
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(rows, c)).alias(f"null_{c}") for c in rows.columns],
        F.min("DATE").alias("first_day"),
        F.max("DATE").alias("last_day"),
        bits.alias("_days"),
        outside.alias("_outside"),
        F.count_if(F.col("PROD_NAME").contains(excluded)).alias("n_excluded"),
        F.count_if(F.col(matched).isNull()).alias("n_unmatched"),
    )
    seen.write.mode("overwrite").partitionBy("YEARMONTH").parquet(path)
    found = dict(checks.get)
    if found.pop("_outside"):
        raise ValueError("a date lies outside 1970 to 2059")
    found["n_days"] = sum(byte.bit_count() for byte in bytes(found.pop("_days")))
    return found

