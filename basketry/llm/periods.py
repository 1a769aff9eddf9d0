"""Periodic runs of words, located by block convolutions at dyadic scales."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.llm.shared import BLANK_WORD, blank_words, map_batches, mix, portions

#: Fewest words of a run.
LEAST = 12

# 15 * 2**27 + 1, a prime, and a generator of its multiplicative group: transforms of up to 2**27 numbers.
_PRIME = 2013265921
_GENERATOR = 31
_P = np.uint64(_PRIME)

# Numbers transformed at a time, unless a single row is longer; bytes of text looked at together.
_SLAB = 1 << 18
_BYTES = 4 << 20


@lru_cache(maxsize=64)
def _powers(half: int, inverse: bool) -> np.ndarray:
    """Powers 0 to half - 1 of a root of unity of order 2 * half."""
    root = pow(_GENERATOR, (_PRIME - 1) // (2 * half), _PRIME)
    root = pow(root, _PRIME - 2, _PRIME) if inverse else root
    out = np.ones(half, np.uint64)
    size = 1
    while size < half:
        out[size : 2 * size] = out[:size] * np.uint64(pow(root, size, _PRIME)) % _P
        size *= 2
    return out


def _transform(rows: np.ndarray) -> np.ndarray:
    """Number-theoretic transform of each row; the results are in bit-reversed order."""
    m, n = rows.shape
    half = n // 2
    while half:
        pairs = rows.reshape(m, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1]
        out = np.empty_like(pairs)
        out[:, :, 0] = (u + v) % _P
        out[:, :, 1] = (u + (_P - v)) * _powers(half, False) % _P
        rows, half = out.reshape(m, n), half // 2
    return rows


def _back(rows: np.ndarray) -> np.ndarray:
    """The inverse of ``_transform``, from bit-reversed order."""
    m, n = rows.shape
    half = 1
    while half < n:
        pairs = rows.reshape(m, -1, 2, half)
        u, v = pairs[:, :, 0], pairs[:, :, 1] * _powers(half, True) % _P
        out = np.empty_like(pairs)
        out[:, :, 0] = (u + v) % _P
        out[:, :, 1] = (u + (_P - v)) % _P
        rows, half = out.reshape(m, n), half * 2
    return rows * np.uint64(pow(n, _PRIME - 2, _PRIME)) % _P


def zero_mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Where each block stands in the window of its row: the sum of squared differences is 0 (mod a prime).

    Sum of (b - w)^2 = sum of b^2 + sum of w^2 - 2 * sum of b * w; the last is a cyclic convolution
    with the reversed block, taken by exact integer transforms. Entries are below the prime.
    """
    m, size = blocks.shape
    width = windows.shape[1]
    n = 1 << (width - 1).bit_length()
    first = np.zeros((m, n), np.uint64)
    first[:, -np.arange(size)] = blocks
    second = np.zeros((m, n), np.uint64)
    second[:, :width] = windows
    products = _back(_transform(first) * _transform(second) % _P)[:, : width - size + 1]
    squares = np.zeros((m, width + 1), np.uint64)
    np.cumsum(windows * windows % _P, axis=1, out=squares[:, 1:])
    around = (squares[:, size:] - squares[:, : width - size + 1]) % _P
    own = (blocks * blocks % _P).sum(axis=1) % _P
    return (own[:, None] + around) % _P == products * np.uint64(2) % _P


@dataclass
class Runs:
    """Runs of some texts: number of the text, first word in it, words, period; by text, start and period."""

    row: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class _Words:
    """Words of some texts one after the other, as numbers, with what the scales look up."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        self.codes, self.sizes = codes, sizes
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(codes)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.end = self.ends[self.row] if n else np.empty(0, np.int64)
        self.values = mix(codes.astype(np.uint64)) % _P
        self.keys = codes * (n + 1) + np.arange(n)
        self.sorted = np.sort(self.keys)

    def met_within(self, at: np.ndarray, low: int, high: int) -> np.ndarray:
        """Whether the word at each place stands again ``low`` to ``high`` words later in its text."""
        found = np.searchsorted(self.sorted, self.keys[at] + low)
        known = np.flatnonzero(found < len(self.sorted))
        last = self.keys[at] - at + np.minimum(at + high, self.end[at] - 1)
        met = np.zeros(len(at), bool)
        met[known] = self.sorted[found[known]] <= last[known]
        return met


def _covered(begin: np.ndarray, stop: np.ndarray, runs: list[np.ndarray], block: int) -> np.ndarray:
    """Whether [begin, stop) lies in a run of which a block holds two periods."""
    if not runs:
        return np.zeros(len(begin), bool)
    s, e, p = np.concatenate(runs, axis=1)
    short = 2 * p <= block
    s, e = s[short], e[short]
    if not len(s):
        return np.zeros(len(begin), bool)
    order = np.argsort(s, kind="stable")
    furthest = np.concatenate([[-1], np.maximum.accumulate(e[order])])
    return furthest[np.searchsorted(s[order], begin, side="right")] >= stop


def _seeds(words: _Words, block: int, low: int, high: int, runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of aligned blocks and the distances, ``low`` to ``high``, at which the block stands again."""
    counts = np.maximum((words.sizes - low - block) // block + 1, 0)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(words.begins, counts) + within * block
    for k in range(block):  # a block can stand again only if each of its words does
        if not len(at):
            break
        at = at[words.met_within(at + k, low, high)]
    if len(at):
        at = at[~_covered(at, np.minimum(at + high + block, words.end[at]), runs, block)]
    width = high - low + block
    rows = max(1, _SLAB // (4 * block))
    places, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i in range(0, len(at), rows):
        x = at[i : i + rows, None]
        window = words.values[np.minimum(x + low + np.arange(width), len(words.values) - 1)]
        hit = zero_mismatches(words.values[x + np.arange(block)], window)
        hit &= x + (low + block) + np.arange(high - low + 1) <= words.end[x]
        which, step = np.nonzero(hit)
        places.append(x[which, 0])
        distances.append(low + step)
    x, q = np.concatenate(places), np.concatenate(distances)
    free = ~_covered(x, x + q + block, runs, block)
    x, q = x[free], q[free]
    same = np.ones(len(x), bool)
    rows = max(1, _SLAB // block)
    for i in range(0, len(x), rows):  # a sum may be a multiple of the prime: compare the words
        each = x[i : i + rows, None] + np.arange(block)
        same[i : i + rows] = (words.codes[each] == words.codes[each + q[i : i + rows, None]]).all(axis=1)
    return x[same], q[same]


def _extended(words: _Words, at: np.ndarray, q: np.ndarray, step: int, chunk: int = 32) -> np.ndarray:
    """The first place from ``at`` on, in steps of 1 or -1, that differs from the one ``q`` words later."""
    at = at.copy()
    alive = np.arange(len(at))
    low, high = words.begins, words.ends
    n = len(words.codes)
    text = words.row[np.clip(at if step > 0 else at + 1, 0, n - 1)]
    while len(alive):
        each = at[alive, None] + step * np.arange(chunk)
        far = each + q[alive, None]
        fits = (each >= low[text[alive], None]) & (far < high[text[alive], None])
        equal = fits & (words.codes[np.clip(each, 0, n - 1)] == words.codes[np.clip(far, 0, n - 1)])
        whole = equal.all(axis=1)
        at[alive] += step * np.where(whole, chunk, equal.argmin(axis=1))
        alive = alive[whole]
    return at


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of texts whose words are given as numbers, one text after the other.

    A run is a stretch of words with smallest period q, of ``least`` words and two periods at least,
    that no neighbouring word extends. At the scale of blocks of 2^k words, the periods from 2^(k+1) - 1
    to 2^(k+2) - 2 are looked for (at the first scale from 1 on): a run of such a period is long enough
    that one of the blocks aligned at multiples of 2^k stands in it together with its copy a period
    later. Each block is convolved with the window of words in which such a copy would stand; the
    distances of its occurrences are seeds, neighbouring seeds of one distance are joined, and both
    ends are extended word by word. Nothing is sampled, so the runs are complete.

    Two exact rules spare convolutions: a block with a word that doesn't stand again in its window
    has no occurrence, and a block of two periods of a known run that holds it and its window has
    occurrences at multiples of that period alone, which belong to the same run.
    """
    if least < 12:
        raise ValueError("the first scale needs runs of 12 words or more")
    words = _Words(codes.astype(np.int64), sizes.astype(np.int64))
    runs: list[np.ndarray] = []
    longest = int(sizes.max()) if len(sizes) else 0
    block = 2
    while True:
        low, high = (1 if block == 2 else 2 * block - 1), 4 * block - 2
        if max(2 * low, least) > longest:
            break
        x, q = _seeds(words, block, low, high, runs)
        if len(x):
            order = np.lexsort((x, q))
            x, q = x[order], q[order]
            new = np.ones(len(x), bool)
            new[1:] = (np.diff(q) != 0) | (np.diff(x) != block)
            first, last = np.flatnonzero(new), np.flatnonzero(np.append(new[1:], True))
            period = q[first]
            begin = _extended(words, x[first] - 1, period, -1) + 1
            stop = _extended(words, x[last] + block, period, 1) + period
            long = stop - begin >= np.maximum(least, 2 * period)
            runs.append(_smallest(np.stack([begin[long], stop[long], period[long]])))
        block *= 2
    if not runs:
        return Runs(*[np.empty(0, np.int64)] * 4)
    begin, stop, period = _smallest(np.concatenate(runs, axis=1))
    order = np.lexsort((period, begin))
    begin, stop, period = begin[order], stop[order], period[order]
    row = words.row[begin]
    return Runs(row, begin - words.begins[row], stop - begin, period)


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each stretch once, with its smallest period."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    new = np.ones(runs.shape[1], bool)
    new[1:] = (np.diff(runs[0]) != 0) | (np.diff(runs[1]) != 0)
    return runs[:, new]


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code


def _collapsed(words: list[bytes], starts: list[int], lengths: list[int], periods: list[int]) -> str:
    """The words without those that repeat an earlier period of a run, joined by single blanks."""
    if starts:
        change = np.zeros(len(words) + 1, np.int64)
        s, n, p = (np.array(v) for v in (starts, lengths, periods))
        np.add.at(change, s + p, 1)
        np.add.at(change, s + n, -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
    return b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """The periodic runs of every text, and the text with each run cut to its first period.

    Returns doc_id, ``n_words``, ``runs`` (an array of start, length and period in words, by start and
    period; see ``runs_of``) and ``collapsed``: the words left when each word that a run holds after its
    first period is dropped, joined by single blanks. Rows stay in their partition; nothing is
    shuffled. Texts are looked at 4 MB at a time, a longer one (up to 2^27 words) by itself.

    Words are those between ASCII blanks, unchanged. A null text is empty; without words there are
    no runs and the rest is empty. Runs may overlap; equal stretches are one run with its smallest
    period. Repeated rows and null doc_ids are rows like any other; other columns, whatever their
    names, are not read; an empty table gives an empty result.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for portion in portions(batch, _BYTES):
                yield _found(portion, least)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    columns = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_batches(rows, find, columns)


def _found(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    lists = [blank_words(t) for t in batch.column("text").to_pylist()]
    sizes = np.array([len(w) for w in lists], np.int64)
    numbers = _Codes()
    codes = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
    runs = runs_of(codes, sizes, least)
    cuts = np.searchsorted(runs.row, np.arange(len(lists) + 1))
    fields = [runs.start, runs.length, runs.period]
    kept = [
        _collapsed(words, *[f[a:b].tolist() for f in fields])
        for words, a, b in zip(lists, cuts[:-1], cuts[1:], strict=True)
    ]
    found = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], names=["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), found), pa.array(kept)],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def planted(text: Column, doc_id: Column) -> Column:
    """The text with a period put into it for a tenth of all doc_ids, by a rule on crc32(doc_id).

    A chosen text's words from a on repeat its words a to a + p - 1. Other texts, and those without a
    word or doc_id, stay as they are.
    """
    words = F.regexp_extract_all(text, F.lit(BLANK_WORD), F.lit(0))
    n = F.greatest(F.size(words), F.lit(1)).cast("long")
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10).cast("long")
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
    times = F.ceil((n - a) / p).cast("int")
    cycle = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(cycle, times)), 1, (n - a).cast("int"))
    chosen = (h % 10 == 0) & (F.size(words) > 0)
    return F.when(chosen, F.array_join(F.concat(F.slice(words, 1, a.cast("int")), tail), " ")).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of them with a planted period, and the longest run of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = periodic_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("_best", longest)
    start, length, period = -F.col("_best.start"), F.col("_best.length"), -F.col("_best.period")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
