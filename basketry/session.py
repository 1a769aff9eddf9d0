"""Sessions and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def local_session(cpus: int | str = "*", name: str = "basketry") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def staging_path(spark: SparkSession, folder: str | None = None) -> str:
    """A fresh path below ``folder``, by default below ``spark.checkpoint.dir``.

    Where neither is given, a session on one machine takes a temporary folder. A cluster raises: a
    folder of one machine would be lost with it.
    """
    global _local_root
    root = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("name a folder that all machines share, or set spark.checkpoint.dir")
        _local_root = _local_root or tempfile.mkdtemp(prefix="basketry-")
        root = _local_root
    return f"{root.rstrip('/')}/basketry-{uuid.uuid4().hex}"


def stage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where several branches of a plan need the same expensive result: the lineage is
    cut, a lost executor costs a re-read instead of a re-run, columns and filters are still
    pruned at the scan, and the planner knows the true size.
    """
    spark = df.sparkSession
    path = staging_path(spark, folder)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows out by ``keys`` over as many tasks as ``spark.sql.shuffle.partitions`` names.

    For groups by ``keys`` (or by these and more columns) that are nearly as many as the rows. Adaptive execution
    merges small partitions until there is one per core, and a core's share of all groups is then held in one
    task's hash table; a number that is asked for is left as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
