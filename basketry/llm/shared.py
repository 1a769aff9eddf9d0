"""Helpers that several corpus operators use: word splitting, staged tables and running totals.

All functions see whole texts. A null text is an empty one. Operators select the columns they
need, so further columns of a table, whatever their names, neither matter nor collide.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Java pattern of a word between ASCII blanks.
BLANK_WORD = "[^\\x20\\x09-\\x0D]+"

#: Rows that a Python function sees at a time.
ROWS = 256

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD_BYTE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)

_local_root: str | None = None
_sent_to: str | None = None
_kept: dict[str, object] = {}


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, unchanged, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def plain_bytes(text: str | None) -> bytes:
    """The text with A-Z lower-cased and every other ASCII character that is no letter or digit blanked.

    Byte offsets stay those of the original.
    """
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTE) if text else b""


def word_hashes(words: Sequence[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (finaliser of a public 64-bit generator)."""
    with np.errstate(over="ignore"):
        v = values.astype(np.uint64, copy=True)
        v ^= v >> np.uint64(30)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        v ^= v >> np.uint64(27)
        v *= np.uint64(0x94D049BB133111EB)
        v ^= v >> np.uint64(31)
    return v


def n_words(text: str = "text") -> Column:
    """Number of words between ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(BLANK_WORD)), F.lit(0)).cast("long")


def staging_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines share.

    Where that setting is absent, a local session takes a temporary folder; a cluster raises.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        _local_root = _local_root or tempfile.mkdtemp(prefix="corpus-")
        root = _local_root
    return f"{root.rstrip('/')}/corpus-{uuid.uuid4().hex}"


def forget(but: str | None = None) -> None:
    """Drop what this process keeps, but for one key."""
    for key in [k for k in _kept if k != but]:
        del _kept[key]


def remembered(key: str, make: Callable):
    """What ``make`` gives, kept by a worker process for later tasks of the same step."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def map_batches(df: DataFrame, function: Callable, schema: T.StructType | str, keeps: str | None = None) -> DataFrame:
    """``df.mapInArrow`` in batches of at most ``ROWS`` rows, so that long texts don't fill the memory.

    The library is sent along, so that workers need not have it installed. A worker process lives on
    from step to step; it first forgets what it has kept, but for the key ``keeps``.
    """
    global _sent_to
    context = df.sparkSession.sparkContext
    if _sent_to != context.applicationId:
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="library-")) / f"{package.name}_library.zip"
        with zipfile.ZipFile(archive, "w") as packed:
            for source in sorted(package.rglob("*.py")):
                packed.write(source, source.relative_to(package.parent))
        context.addPyFile(str(archive))  # the driver hands it to every worker
        _sent_to = context.applicationId

    def in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        return function(b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))

    return df.mapInArrow(in_slices, schema)


def portions(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold at most so many bytes of text, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    at, held = 0, 0
    for row, size in enumerate(sizes):
        if row > at and held + size > most:
            yield batch.slice(at, row - at)
            at, held = row, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def spare(name: str, df: DataFrame) -> str:
    """``name``, with as many marks behind it as it takes to differ from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to shared storage and read it back; a lost executor then costs a re-read."""
    path = staging_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int = 100_000) -> int:
    """Partitions for so many small rows."""
    return 1 + rows // each


def running_totals(
    df: DataFrame, order: Sequence[str], values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """``df`` with ``<v>_before`` for each value column: its sum over all earlier rows of the same ``by``.

    Rows go to range partitions on (by, order), so a group that holds a third of all rows is spread
    over many tasks. Each task adds up its own rows; the totals of whole partitions, one row per
    partition and group, give what lies before. The partitioned rows are staged, because later steps
    need the very same partitions. Null is a group of its own and sorts first.
    """
    keys = [*by, *order]
    befores = [f"{v}_before" for v in values]
    placed = T.StructType(
        [*df.schema.fields, T.StructField("_part", T.IntegerType())]
        + [T.StructField(b, T.LongType()) for b in befores]
    )

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        carry = dict.fromkeys(values, 0)
        for rows in batches:
            n = rows.num_rows
            if not n:
                continue
            groups = list(zip(*[rows.column(k).to_pylist() for k in by], strict=True)) if by else [()] * n
            if groups[0] != last:
                carry = dict.fromkeys(values, 0)
            starts = [i for i in range(1, n) if groups[i] != groups[i - 1]] if by else []
            last = groups[-1]
            columns = []
            for v in values:
                x = rows.column(v).to_numpy(zero_copy_only=False).astype(np.int64)
                total = np.cumsum(x) - x + carry[v]
                if starts:
                    base = np.zeros(n, np.int64)
                    base[starts] = np.diff(total[starts], prepend=0)
                    total = total - np.cumsum(base)
                carry[v] = int(total[-1] + x[-1])
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *befores])

    sorted_rows = (
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
    )
    placed_rows = stage(map_batches(sorted_rows, within, placed))
    ends = placed_rows.groupBy(*by, "_part").agg(
        *[F.max(F.col(b) + F.col(v)).alias(f"{v}_sum") for v, b in zip(values, befores, strict=True)]
    )
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.select(
        *[F.col(k).alias(f"_{k}") for k in by],
        F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"{v}_sum").over(earlier), F.lit(0)).alias(f"_{v}_offset") for v in values],
    )
    same = F.col("_part") == F.col("_p")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return placed_rows.join(offsets, same).select(
        *df.columns, *[(F.col(b) + F.col(f"_{v}_offset")).alias(b) for v, b in zip(values, befores, strict=True)]
    )

