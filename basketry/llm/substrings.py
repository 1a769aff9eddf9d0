"""Passages that occur more than once, found by factoring documents against indexed reference blocks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.shared import blank_words, map_batches, mix, stage, word_hashes

#: Words of a window, and of the seed that anchors a block; a block covers the windows of one seed.
WINDOW = 35
SEED = 8

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _runs(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on (positions too near the end: meaningless)."""
    total: np.ndarray | None = None
    done, piece, size = 0, h.copy(), 1
    with np.errstate(over="ignore"):
        power = _BASE
        while True:
            if length & size:
                shifted = _shift(piece, done)
                total = piece if total is None else total * power + shifted
                done += size
            if done == length:
                return mix(total)
            piece = piece * power + _shift(piece, size)
            power = power * power
            size *= 2


def _shift(values: np.ndarray, by: int) -> np.ndarray:
    if not by:
        return values
    out = np.zeros_like(values)
    out[:-by] = values[by:]
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of the ``width`` values from each position on."""
    at = np.arange(len(values))
    best, size = values, 1

    def meet(step: int) -> None:
        nonlocal best, at
        far, far_at = _shift(best, step), _shift(at, step)
        if step:
            far[-step:] = np.iinfo(np.uint64).max
        less = far < best
        best, at = np.where(less, far, best), np.where(less, far_at, at)

    while size * 2 <= width:
        meet(size)
        size *= 2
    if width > size:
        meet(width - size)
    return at


@dataclass
class Blocks:
    """Blocks of some texts: consecutive windows of one text with the same seed.

    ``row``: number of the text; ``first``: first window; ``count``: windows; ``seed``: hash of the
    seed; ``content``: hash of all windows of the block. ``window``: hash of every window, from
    ``start`` of its block on.
    """

    row: np.ndarray
    first: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    content: np.ndarray
    start: np.ndarray
    window: np.ndarray


def blocks_of(word_lists: Sequence[Sequence[bytes]], window: int = WINDOW, seed: int = SEED) -> Blocks:
    """The blocks of some texts; texts of fewer words than a window have none.

    The seed of a window is its smallest (by hash) run of ``seed`` words. It depends on the words of
    the window alone, so equal windows, wherever they stand, lie at the same place of blocks with
    equal seeds.
    """
    sizes = np.array([len(w) for w in word_lists], np.int64)
    ends = np.cumsum(sizes)
    n = int(ends[-1]) if len(ends) else 0
    empty = np.empty(0, np.int64)
    if n < window:
        return Blocks(empty, empty, empty, *[np.empty(0, np.uint64)] * 2, empty, np.empty(0, np.uint64))
    h = np.concatenate([word_hashes(w) for w in word_lists])
    seeds = _runs(h, seed)
    at = _least(seeds, window - seed + 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    valid = np.flatnonzero(np.arange(n) + window <= ends[row])
    if not len(valid):
        return Blocks(empty, empty, empty, *[np.empty(0, np.uint64)] * 2, empty, np.empty(0, np.uint64))
    at, where = at[valid], row[valid]
    with np.errstate(over="ignore"):
        value = mix(_runs(h, window)[valid] + (at - valid).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    new = np.ones(len(valid), bool)
    new[1:] = (at[1:] != at[:-1]) | (where[1:] != where[:-1])
    start = np.flatnonzero(new)
    with np.errstate(over="ignore"):
        content = np.add.reduceat(value, start)
    begin = ends - sizes
    return Blocks(
        where[start],
        valid[start] - begin[where[start]],
        np.diff(np.append(start, len(valid))),
        seeds[at[start]],
        content,
        start,
        value,
    )


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Rows with the words of their texts, which may be packed."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if "packed" in part.schema.names:
                yield part, [unpack.decompress(t).split() for t in part.column("packed").to_pylist()]
            else:
                yield part, [blank_words(t) for t in part.column("text").to_pylist()]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, so that they move and are stored at about half their size."""
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        texts = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(texts, pa.binary())], names=[*names, "packed"])


def repeated_passages(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document with the words that lie in a window which also starts anywhere else.

    The corpus is cut into reference blocks, each anchored by a seed that its words determine, and
    all of them are indexed by seed: one count per seed, combined in the tasks, so a passage in a
    third of all documents is no hot group. A document is then factored greedily: neighbouring
    blocks that equal every indexed block of their seed join into one factor. Where blocks of a seed
    differ, a factor ends inside, and there the windows themselves are looked up. Both tests are exact
    up to 128-bit hashes; nothing is sampled.

    Texts move compressed: all to meet the marks of their blocks, and those with marks once more to meet the
    windows found in them.

    Returns doc_id, ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one blank),
    ``removed`` (spans of words, [first, one past the last]) and ``factors`` (first word, words, the
    smallest doc_id of the reference block). Words are those between ASCII blanks, unchanged. A null,
    empty or short text has no window and loses nothing; repeated rows are occurrences of each other;
    null is a doc_id like any other; an empty table gives an empty result.
    """
    base = docs.select(
        "doc_id",
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_d"),
        F.xxhash64("text", F.col("doc_id").isNull()).alias("_t"),
    )

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches):
            b = blocks_of(words, window)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c).take(pa.array(b.row)) for c in ("_d", "_t")],
                    _signed(b.seed),
                    _signed(b.content),
                    pa.array(b.first.astype(np.int32)),
                    pa.array(b.count.astype(np.int32)),
                ],
                names=["_d", "_t", "seed", "content", "first", "count"],
            )

    blocks = map_batches(
        base.select("_d", "_t", "text"), index, "_d long, _t long, seed long, content long, first int, count int"
    )
    repeated = stage(
        blocks.groupBy("seed")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.min("content").alias("_low"),
            F.max("content").alias("_high"),
            F.min("_d").alias("reference"),
        )
        .filter("_n > 1")
        .select("seed", (F.col("_low") == F.col("_high")).alias("same"), "reference")
    )
    marks = blocks.select("_d", "_t", "seed", "first", "count").join(repeated, "seed")
    marked = marks.groupBy("_d", "_t").agg(
        F.collect_set(F.struct("first", "count", "same", "reference")).alias("marks")
    )
    packed = map_batches(base, _pack, f"doc_id {dict(base.dtypes)['doc_id']}, _d long, _t long, packed binary")
    met = stage(packed.join(marked, ["_d", "_t"]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches, 64):
            b = blocks_of(words, window)
            marks = part.column("marks")
            flat, row = marks.flatten(), pc.list_parent_indices(marks).to_numpy()
            open_ = ~flat.field("same").to_numpy(zero_copy_only=False)
            key = (row.astype(np.int64) << 40) | flat.field("first").to_numpy()
            picked = np.isin((b.row << 40) | b.first, key[open_])
            counts = b.count[picked]
            inner = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
            rows = np.repeat(b.row[picked], counts)
            yield pa.RecordBatch.from_arrays(
                [
                    *[part.column(c).take(pa.array(rows)) for c in ("_d", "_t")],
                    _signed(np.repeat(b.seed[picked], counts)),
                    _signed(b.window[np.repeat(b.start[picked], counts) + inner]),
                    pa.array((np.repeat(b.first[picked], counts) + inner).astype(np.int32)),
                ],
                names=["_d", "_t", "seed", "value", "at"],
            )

    open_texts = met.filter(F.exists("marks", lambda m: ~m["same"])).select("_d", "_t", "packed", "marks")
    windows = map_batches(open_texts, look_up, "_d long, _t long, seed long, value long, at int")
    found = stage(
        windows.groupBy("seed", "value").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("seed", "value")
    )
    placed = windows.join(found, ["seed", "value"]).groupBy("_d", "_t").agg(F.collect_set("at").alias("windows"))
    parsed = met.join(placed, ["_d", "_t"], "left")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches):
            yield _result(part.column("doc_id"), words, part.column("marks").to_pylist(), part.column("windows").to_pylist(), window)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, words in _texts(batches):
            plain = _result(part.column("doc_id"), words, [()] * len(words), [()] * len(words), window)
            yield pa.RecordBatch.from_arrays(
                [part.column("_d"), part.column("_t"), *plain.columns], names=["_d", "_t", *plain.schema.names]
            )

    columns = (
        "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<array<long>>, factors array<array<long>>"
    )
    known = base.withColumn("doc_id", F.col("doc_id").cast("long"))
    rest = map_batches(known, untouched, f"_d long, _t long, {columns}")
    rest = rest.join(met.select("_d", "_t").distinct(), ["_d", "_t"], "left_anti").drop("_d", "_t")
    parsed = parsed.withColumn("doc_id", F.col("doc_id").cast("long"))
    return rest.union(map_batches(parsed.select("doc_id", "packed", "marks", "windows"), parse, columns))


def factors_of(marks: Sequence[dict], window: int) -> list[list[int]]:
    """Greedy factors: runs of neighbouring blocks found whole, all with the same reference document."""
    factors: list[list[int]] = []
    follows, reference = -1, None
    for m in sorted((m for m in marks if m["same"]), key=lambda m: m["first"]):
        if m["first"] == follows and m["reference"] == reference:
            factors[-1][1] += m["count"]
        else:
            factors.append([m["first"], m["count"] + window - 1, m["reference"]])
        follows, reference = m["first"] + m["count"], m["reference"]
    return factors


def removed_spans(factors: Sequence[Sequence[int]], windows: Sequence[int], window: int) -> list[list[int]]:
    """Union of the factors and of the single windows found at their boundaries."""
    spans: list[list[int]] = []
    for first, end in sorted([(f[0], f[0] + f[1]) for f in factors] + [(w, w + window) for w in windows]):
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    return spans


def _result(doc_ids, word_lists, marks_of, windows_of, window) -> pa.RecordBatch:
    removed, factors, kept = [], [], []
    for words, marks, windows in zip(word_lists, marks_of, windows_of, strict=True):
        factors.append(factors_of(marks, window))
        spans = removed_spans(factors[-1], windows or (), window)
        removed.append(spans)
        left: list[bytes] = []
        at = 0
        for first, end in spans:
            left += words[at:first]
            at = end
        left += words[at:]
        kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
    pairs = pa.list_(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array([len(w) for w in word_lists], pa.int64()),
            pa.array([sum(b - a for a, b in r) for r in removed], pa.int64()),
            pa.array(kept),
            pa.array(removed, pairs),
            pa.array(factors, pairs),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed", "factors"],
    )


def op10_repeated_passages(spark, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a window of 35 words found anywhere else."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS win
  FROM words, unnest(range(1, len(w) - 33)) AS t(i)
), twice AS (
  SELECT win FROM windows GROUP BY win HAVING count(*) > 1
), covered AS (
  SELECT DISTINCT doc_id, p FROM windows JOIN twice USING (win), unnest(range(i, i + 35)) AS t(p)
), kept AS (
  SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.p) FILTER (c.p IS NULL) AS line, count(c.p) AS n_removed
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words) d
  LEFT JOIN covered c ON c.doc_id = d.doc_id AND c.p = d.p
  GROUP BY d.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.line, '')) AS kept_sha256
FROM words w LEFT JOIN kept k USING (doc_id)
"""
