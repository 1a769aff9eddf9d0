"""Mixing sources to target weights: blocks of words, drawn per output shard and fetched by index."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.shared import map_batches, mix, n_words, running_totals, spare, stage

#: Words of a block, blocks of an output shard, and how often a document may be taken at most.
BLOCK = 128
SHARD_BLOCKS = 1024
MOST = 3
#: Output shards, about, whose slots a task lists.
TASK_SHARDS = 64
#: Sources that the plan, one row for each on the driver and in each task, may have.
MAX_SOURCES = 100_000

SEED = 20_011

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class Source:
    """A source: its words, target, blocks and the slots that the target is worth."""

    name: str | None
    size: int
    target: float
    blocks: int
    slots: int


def repeating_weights(n: int, weights: Sequence[float] = (5.0, 2.0, 1.0)) -> list[float]:
    """The weights, again from the first where there are more sources."""
    return [weights[i % len(weights)] for i in range(n)]


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = MOST) -> list[float]:
    """Shares of the total by weight; none above ``most`` times its size, the excess reshared by weight.

    The source whose limit is least for its weight reaches it first, so one pass in that order
    finds all that stop at their limit.
    """
    left, weight = float(sum(sizes)), float(sum(weights))
    result = [0.0] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for k, i in enumerate(order):
        if most * sizes[i] * weight < left * weights[i]:
            result[i] = float(most * sizes[i])
            left -= result[i]
            weight -= weights[i]
            continue
        for j in order[k:]:
            result[j] = left * weights[j] / weight
        break
    return result


def plan(
    sized: DataFrame, weights: Callable[[int], Sequence[float]], block: int, most: int
) -> list[Source]:
    """One entry per source, by code point, null last. The driver gets one row per source."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("size")).orderBy(F.col("source").asc_nulls_last())
    found = rows.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"a mixture has at most {MAX_SOURCES} sources, each with its weight")
    sizes = [int(r["size"]) for r in found]
    goal = targets(sizes, list(weights(len(found))), most)
    blocks = [-(-s // block) for s in sizes]
    slots = [round(g / s * b) if s else 0 for g, s, b in zip(goal, sizes, blocks, strict=True)]
    return [Source(r["source"], *x) for r, x in zip(found, zip(sizes, goal, blocks, slots, strict=True), strict=True)]


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where keyed pseudorandom permutations of 0 to n - 1 send x (elementwise; Feistel rounds).

    The rounds permute a power of four that holds n; values outside 0 to n - 1 go round again.
    """
    half = np.array([max(1, (int(m - 1).bit_length() + 1) // 2) for m in np.unique(n)], np.uint64)
    half = half[np.searchsorted(np.unique(n), n)]
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = x.astype(np.uint64), np.arange(len(x))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half[todo], out[todo] & mask[todo]
            for turn in range(4):
                salt = key[todo] + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15)
                left, right = right, left ^ (mix(right + salt) & mask[todo])
            out[todo] = (left << half[todo]) | right
            todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _key(*parts: object) -> int:
    return xxhash.xxh64_intdigest(repr(parts))


def _scaled(i: np.ndarray, part: int, whole: int) -> np.ndarray:
    """floor(i * part / whole), exact also where the product exceeds 64 bits."""
    if whole * max(part, 1) < 2**62:
        return i * part // max(whole, 1)
    return np.array([int(x) * part // whole for x in i], np.int64)


def draw(spark: SparkSession, sources: Sequence[Source], shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """Slots of all output shards: shard, slot, src (number of the source), pass, block.

    Every shard draws its source counts from a multinomial with the target shares, each with a
    generator of its own, so shards are drawn in parallel and a rerun draws the same. What the draws
    of all shards together exceed the slots of a source is given up, evenly spread over the shards,
    to sources that lack slots; so each source gets exactly the slots its target is worth. Slot o of
    a source with n blocks takes, in pass o div n, the block to which a permutation keyed by source
    and pass sends o mod n; a pass takes no block twice.
    """
    wanted = np.array([s.slots for s in sources], np.int64)
    total = int(wanted.sum())
    shards = -(-total // shard_blocks)
    share = wanted / max(total, 1)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard_of, src_of, n_of = [], [], []
            for shard in batch.column(0).to_pylist():
                size = min(shard_blocks, total - shard * shard_blocks)
                counts = np.random.Generator(np.random.Philox(key=[seed, shard])).multinomial(size, share)
                held = np.flatnonzero(counts)
                shard_of += [shard] * len(held)
                src_of += held.tolist()
                n_of += counts[held].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (shard_of, src_of, n_of)], names=["shard", "src", "n"])

    numbers = spark.range(shards).select("id")
    drawn = map_batches(numbers, counted, "shard long, src long, n long")
    placed = running_totals(drawn, ["shard"], ["n"], by=["src"])
    sums = dict(placed.groupBy("src").agg(F.sum("n")).collect())  # a row per source
    had = np.array([int(sums.get(i, 0)) for i in range(len(sources))], np.int64)
    excess = had - wanted
    given = np.maximum(excess, 0)
    lacking = np.maximum(-excess, 0)
    given_from = np.cumsum(given) - given
    lacks_from = np.cumsum(lacking)
    moved = int(given.sum())
    blocks = np.array([max(s.blocks, 1) for s in sources], np.int64)
    names = [s.name for s in sources]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, parts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                srcs, orders = [], []
                for src, first, n in sorted((p["src"], p["first"], p["n"]) for p in parts):
                    i = np.arange(first, first + n)
                    d, k = int(given[src]), int(had[src])
                    before = _scaled(i, d, k)
                    gives = _scaled(i + 1, d, k) > before
                    srcs.append(np.full(int((~gives).sum()), src))
                    orders.append((i - before)[~gives])
                    if gives.any():
                        g = permuted(given_from[src] + before[gives], np.full(int(gives.sum()), moved), np.full(int(gives.sum()), _key(seed, "moved"), np.uint64))
                        to = np.searchsorted(lacks_from, g, side="right")
                        srcs.append(to)
                        orders.append(had[to] + g - (lacks_from[to] - lacking[to]))
                src, order = np.concatenate(srcs), np.concatenate(orders)
                turn = order // blocks[src]
                pairs, back = np.unique(np.stack([src, turn]), axis=1, return_inverse=True)
                keys = np.array([_key(seed, names[s], int(t)) for s, t in pairs.T.tolist()], np.uint64)[back.reshape(-1)]
                block = permuted(order % blocks[src], blocks[src], keys)
                slot = np.random.Generator(np.random.Philox(key=[seed + 1, shard])).permutation(len(src))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (np.full(len(src), shard), slot, src, turn, block)],
                    names=["shard", "slot", "src", "pass", "block"],
                )

    spread = placed.repartition(1 + shards // TASK_SHARDS, "shard")  # each row becomes a shard's slots: no merging by bytes
    whole = spread.groupBy("shard").agg(
        F.collect_list(F.struct("src", F.col("n_before").alias("first"), "n")).alias("parts")
    )
    return map_batches(whole, dealt, "shard long, slot long, src long, pass long, block long")


@dataclass(frozen=True)
class Mixture:
    """``rows``: the documents with size, src and start (words of the source before); ``taken``: the
    pieces of documents that the mix takes, each with shard, slot, pass, first word and words."""

    sources: list[Source]
    rows: DataFrame
    taken: DataFrame


def mixture(
    docs: DataFrame,
    weights: Callable[[int], Sequence[float]] = repeating_weights,
    block: int = BLOCK,
    shard_blocks: int = SHARD_BLOCKS,
    most: int = MOST,
    seed: int = SEED,
    carry: Sequence[str] = (),
) -> Mixture:
    """Mix the words of all documents so that each source comes near its target.

    Sizes are words between ASCII blanks. The words of a source, documents in order of doc_id, are
    packed into blocks of ``block`` words; a document's offset is a running total over range
    partitions, so no source is gathered. Slots meet the blocks by (source, block), at most
    ``most`` to a block, in a merge join whatever their number. Texts don't move.

    Null is a source of its own, last in order. Empty and null texts have no words and are never
    taken. Repeated rows are documents of their own. Without words nothing is drawn.
    """
    taken_columns = [c for c in carry if c not in {"doc_id", "source", "size", "src", "start"}]
    sized = stage(docs.select("doc_id", "source", *taken_columns, n_words().alias("size")))
    sources = plan(sized, weights, block, most)
    spark = docs.sparkSession
    numbers = spark.createDataFrame([(s.name, i) for i, s in enumerate(sources)], "_name string, src long")
    rows = (
        running_totals(sized, ["doc_id", *taken_columns, "size"], ["size"], by=["source"])
        .withColumnRenamed("size_before", "start")
        .join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("_name")))  # at most MAX_SOURCES rows
        .drop("_name")
    )
    pieces = rows.filter("size > 0").withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")))
    )
    first: Column = F.greatest(F.col("start"), F.col("block") * block)
    end: Column = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select(
        "doc_id", *taken_columns, "src", "start", "block", (first - F.col("start")).alias("first"), (end - first).alias("words")
    )
    slots = draw(spark, sources, shard_blocks, seed)
    # Slots are listed from a few counts a shard, by whose size they would be judged small enough to broadcast.
    return Mixture(sources, rows, pieces.join(slots.hint("merge"), ["src", "block"]))


def runs_of(ranges: Sequence[dict]) -> list[tuple[int, int]]:
    """Ranges (first, words) in order, as (first word, end) with those that follow each other joined."""
    runs: list[tuple[int, int]] = []
    for r in ranges:
        first, end = r["first"], r["first"] + r["words"]
        if runs and runs[-1][1] == first:
            runs[-1] = (runs[-1][0], end)
        else:
            runs.append((first, end))
    return runs


def mixed_passages(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: one per run of blocks taken of a document in a pass.

    ``text`` is cut out of the document from the first to the last word of the run, with all white space
    in between, and ``n_chars`` its length; other columns stay. Blocks that don't follow each other give
    rows of their own, so every text is a substring of its document. A document of which nothing is
    taken is left out.
    """
    return _cut(docs, True, options)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of ``docs``: one per document and pass, with the words taken in that pass.

    ``text`` holds the passages of ``mixed_passages`` with a single blank between those that don't follow
    each other, and ``n_chars`` its length; other columns stay. A document of which nothing is taken is
    left out; one taken twice gives two rows.
    """
    return _cut(docs, False, options)


def _cut(docs: DataFrame, apart: bool, options: dict) -> DataFrame:
    own, doc, chosen_ranges, passes_of = (spare(f"_mix_{part}", docs) for part in ("text", "doc", "ranges", "all"))
    keyed = docs.withColumn(own, F.xxhash64(*docs.columns))
    found = mixture(keyed, carry=[own], **options).taken
    ranges = found.groupBy(F.col("doc_id").alias(doc), own, "start", "pass").agg(
        F.array_sort(F.collect_list(F.struct("first", "words"))).alias(chosen_ranges)
    )
    chosen = ranges.groupBy(doc, own).agg(F.collect_list(chosen_ranges).alias(passes_of))
    texts = keyed.groupBy(F.col("doc_id").alias(doc), own).agg(*[F.first(c).alias(c) for c in docs.columns])
    same = texts[doc].eqNullSafe(chosen[doc]) & (texts[own] == chosen[own])
    both = texts.join(chosen, same).select(*[texts[c] for c in docs.columns], passes_of)

    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, sizes = [], [], []
            for k, (text, passes) in enumerate(zip(batch.column("text").to_pylist(), batch.column(passes_of).to_pylist(), strict=True)):
                whole = text.encode("utf-8", "surrogatepass")
                words = [m.span() for m in _WORD.finditer(whole)]
                for ranges in passes:
                    found = [whole[words[first][0] : words[end - 1][1]] for first, end in runs_of(ranges)]
                    for passage in found if apart else [b" ".join(found)]:
                        line = passage.decode("utf-8", "surrogatepass")
                        rows.append(k)
                        texts.append(line)
                        sizes.append(len(line))
            taken = batch.take(pa.array(rows, pa.int64()))
            columns = list(taken.columns)
            columns[text_at] = pa.array(texts, pa.string())
            columns[chars_at] = pa.array(sizes, pa.int64())
            yield pa.RecordBatch.from_arrays(columns[:-1], names=names)

    return map_batches(both, cut, docs.schema)


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with sources weighing 5, 2, 1 in turn."""
    made = mixture(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = made.taken.groupBy(F.col("src").alias("_src"), F.col("start").alias("_start")).agg(F.sum("words").alias("_taken"))
    facts = spark.createDataFrame(
        [(i, s.size, s.target) for i, s in enumerate(made.sources)], "_i long, source_size long, target double"
    )
    rows = made.rows.join(F.broadcast(facts), F.col("src") == F.col("_i"))  # at most MAX_SOURCES rows
    met = (F.col("src") == F.col("_src")) & (F.col("start") == F.col("_start")) & (F.col("size") > 0)
    return rows.join(taken, met, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).alias("taken"), "source"
    )
