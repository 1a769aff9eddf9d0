"""Benchmark passages in documents, found by one Aho-Corasick automaton over all test items."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.llm.shared import map_batches, plain_bytes, remembered, running_totals, spare, stage

#: Words of a window.
WINDOW = 10
#: Bytes of window text that one automaton holds; a node takes about 40 bytes per character.
AUTOMATON_BYTES = 8_000_000

_FOUND = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("found", T.ArrayType(T.LongType())),
    T.StructField("runs", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct normalised windows of all items, each with the ids of items that hold it: window, item; staged.

    An item of fewer words than a window is one window; an item without words, or without text,
    has none. An item without id still gives its windows, with a null. Items of a window are rows, so
    one that a third of the items holds is gathered nowhere.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = []
            for item, text in zip(*[c.to_pylist() for c in rows.columns], strict=True):
                words = plain_bytes(text).decode().split(" ")
                words = [w for w in words if w]
                if words:
                    for i in range(max(1, len(words) - window + 1)):
                        found.append((" ".join(words[i : i + window]), item))
            yield pa.RecordBatch.from_pydict(
                {"window": pa.array([w for w, _ in found], pa.string()), "item": pa.array([i for _, i in found], pa.int64())}
            )

    cuts = map_batches(benchmark.select(F.col("item_id").cast("long"), "text"), cut, "window string, item long")
    return stage(cuts.distinct())


def grouped(windows: DataFrame, limit: int) -> DataFrame:
    """Distinct windows with a ``number`` each and the ``part`` it is in; staged.

    A part holds at most ``limit`` bytes of text and one window. Numbers and parts follow from running totals in the
    windows' order, so neither the driver nor a task sees them all.
    """
    sized = windows.select("window").distinct().select("window", F.octet_length("window").cast("long").alias("size"), F.lit(1).cast("long").alias("one"))
    totals = running_totals(sized, ["window"], ["size", "one"])
    return stage(totals.select("window", F.col("one_before").alias("number"), F.expr(f"size_before div {limit}").alias("part")))


def _built(windows: Sequence[tuple[str, int]]) -> ahocorasick.Automaton:
    """The automaton of a part of the windows."""
    machine = ahocorasick.Automaton()
    for text, number in windows:
        machine.add_word(f" {text} ", (len(text) + 2, text.count(" ") + 1, number))
    machine.make_automaton()
    return machine


def find(text: str | None, machine) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Words of the text, numbers of windows found, and maximal runs of hit words as (first, one past the last)."""
    words = plain_bytes(text).split()
    if not words:
        return 0, [], []
    line = f" {b' '.join(words).decode()} "
    matches = [(end - length + 1, count, number) for end, (length, count, number) in machine.iter(line)] if len(machine) else []
    if not matches:
        return len(words), [], []
    blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), np.uint32) == 32)
    firsts = np.searchsorted(blanks, [at for at, _, _ in matches])
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, firsts, 1)
    np.add.at(step, firsts + np.array([count for _, count, _ in matches]), -1)
    hit = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(hit))
    numbers = sorted({number for _, _, number in matches})
    return len(words), numbers, list(zip(turns[::2].tolist(), turns[1::2].tolist(), strict=True))


def original_spans(text: str, runs: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Runs of words as character spans [start, end) of the unnormalised text."""
    plain = np.frombuffer(plain_bytes(text), np.uint8)
    inside = np.concatenate([[0], (plain != 32).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(inside))
    starts, ends = turns[::2], turns[1::2]
    raw = text.encode("utf-8", "surrogatepass")
    chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # characters up to each byte
    before = np.concatenate([[0], chars])
    return [[int(before[starts[a]]), int(before[ends[b - 1]])] for a, b in runs]


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: Sequence[str] = (),
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
    items: bool = True,
) -> DataFrame:
    """Every document with the benchmark words it holds.

    Texts and items are normalised alike: A-Z lower-cased, words of ASCII letters, digits and all
    other characters beyond ASCII. A word inside any occurrence of a window is hit.

    Returns doc_id, the columns in ``carry``, ``n_words``, ``n_hit``, ``items`` (sorted distinct
    ids), ``runs`` (hit words, [first, one past the last]) and ``spans`` (the same as characters of
    the original text). An empty or null text has no words and no hits; an empty benchmark hits
    nothing; repeated rows are judged each by itself. Very long texts are scanned whole, row by row. Columns that
    bear the name of a result are replaced by it, all others in ``carry`` stay as they are.

    The automaton holds windows and their numbers. Which items hold a window stays in a staged table, and
    the windows that a document holds are joined to it; without ``items`` that column and the join are left
    out, and no carried text moves.

    The windows are broadcast only up to ``automaton_bytes`` (and one window). A larger benchmark is cut into parts
    of that size, read one at a time; every part scans the documents with its own automaton and the runs of a row are
    merged, so memory stays bounded and nothing is left out.
    """
    results = {"doc_id", "items", *[f.name for f in _FOUND]}
    taken = [c for c in carry if c not in results]
    rows = docs.select(*dict.fromkeys(["doc_id", "text", *taken]))
    row = spare("_row", rows)
    cuts = windows_of(benchmark, window)
    windows = grouped(cuts, automaton_bytes)
    last = windows.agg(F.max("part")).first()[0]
    if not last:
        marked = rows.withColumn(row, F.monotonically_increasing_id()) if items else rows
        every = _scanned(marked, _part(windows, 0), [*taken, *([row] if items else [])])
    else:
        rows = stage(rows.withColumn(row, F.monotonically_increasing_id()))
        every = None
        for part in range(last + 1):
            found = _scanned(rows.select(row, "doc_id", "text"), _part(windows, part), [row])
            every = every.union(found) if every is not None else found
        merged = every.groupBy(row).agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("found")).alias("found"),
            F.flatten(F.collect_list("runs")).alias("runs"),
        )
        every = _merged(rows.join(merged, row), [*taken, row])
    if not items:
        return every.select("doc_id", *taken, "n_words", "n_hit", "runs", "spans")
    every = stage(every)
    names = cuts.filter("item is not null").join(windows, "window").select("number", "item")
    at = spare("_at", every)
    held = every.select(F.col(row).alias(at), F.explode("found").alias("number")).join(names, "number")
    listed = held.groupBy(at).agg(F.sort_array(F.collect_set("item")).alias("items"))
    none = F.array().cast("array<bigint>")
    return every.join(listed, F.col(row) == F.col(at), "left").select(
        "doc_id", *[every[c] for c in taken], "n_words", "n_hit", F.coalesce("items", none).alias("items"), "runs", "spans"
    )


def without_hits(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no word is hit, with all their columns, whatever these are called.

    Rows without text have no words and stay; repeated rows all stay or all go; an empty benchmark leaves all.
    """
    names = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in {"doc_id", "text"}}
    renamed = docs.select(*[F.col(c).alias(names.get(c, c)) for c in docs.columns])
    found = scan(renamed, benchmark, carry=["text", *names.values()], items=False, **options)
    return found.filter("n_hit = 0").select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def _part(windows: DataFrame, part: int) -> list[tuple[str, int]]:
    """The windows of one part with their numbers, on the driver."""
    return [tuple(r) for r in windows.filter(F.col("part") == part).select("window", "number").toLocalIterator()]


def _scanned(rows: DataFrame, windows: list[tuple[str, int]], taken: Sequence[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(windows)
    key = uuid.uuid4().hex
    kept = ["doc_id", *taken]
    schema = T.StructType([*[rows.schema[c] for c in kept], *_FOUND])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = remembered(key, lambda: _built(shared.value))
        for batch in batches:
            found = defaultdict(list)
            for text in batch.column("text").to_pylist():
                n, numbers, runs = find(text, machine)
                found["n_words"].append(n)
                found["n_hit"].append(sum(b - a for a, b in runs))
                found["found"].append(numbers)
                found["runs"].append([list(r) for r in runs])
                found["spans"].append(original_spans(text, runs) if runs else [])
            pairs = pa.list_(pa.list_(pa.int64()))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pairs, pairs]
            new = [pa.array(found[f.name], kind) for f, kind in zip(_FOUND, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], *new], names=[*kept, *[f.name for f in _FOUND]]
            )

    return map_batches(rows, matched, schema, keeps=key)


def _merged(rows: DataFrame, taken: Sequence[str]) -> DataFrame:
    """Rows with the runs of all parts: runs that meet joined, and what follows from them."""
    kept = ["doc_id", *taken]
    both = rows.select(*dict.fromkeys([*kept, "text"]), "n_words", "found", "runs")
    schema = T.StructType([*[both.schema[c] for c in kept], *_FOUND])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs_of, spans_of = [], []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                joined: list[list[int]] = []
                for a, b in sorted(runs):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], b)
                    else:
                        joined.append([a, b])
                runs_of.append(joined)
                spans_of.append(original_spans(text, joined) if joined else [])
            pairs = pa.list_(pa.list_(pa.int64()))
            hits = pa.array([sum(b - a for a, b in r) for r in runs_of], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], batch.column("n_words"), hits, batch.column("found"), pa.array(runs_of, pairs), pa.array(spans_of, pairs)],
                names=[*kept, *[f.name for f in _FOUND]],
            )

    return map_batches(both, united, schema)


def op8_benchmark_hits(spark, sf_dir: str) -> DataFrame:
    """Benchmark words of every document and a digest of the items found in it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(named, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM item_words, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i)
  WHERE len(w) > 0
), lengths AS (
  SELECT DISTINCT n FROM item_windows
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM words, lengths, unnest(range(1, len(w) - n + 2)) AS t(i)
), matches AS (
  SELECT d.doc_id, d.i, d.n, x.item_id FROM doc_windows d JOIN item_windows x ON d.n = x.n AND d.win = x.win
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM matches, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM matches) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(k.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h USING (doc_id) LEFT JOIN named k USING (doc_id)
"""
