"""Exact quartiles from mergeable sketches and a few narrow passes, and column summaries built on them.

A sketch (KLL) of a column tells, for any rank, a value whose true rank is near. Sketches of parts, such as
months, merge into that of the whole. Around each wanted rank the merged sketch gives a bracket; one pass
counts what lies below, at and between its ends, and sketches what lies between, which gives the next, much
narrower bracket. When few values are left between, they are fetched. Ends that many rows share cost
nothing, since they are counted by themselves, so the number of rounds doesn't depend on ties.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.values import known_number
from basketry.session import stage

QUARTERS = (("q1", 1), ("median", 2), ("q3", 3))

#: Size of the sketches; their rank error is about 2 / SIZE.
SIZE = 4096

# Steps in which a sketch is read; a bracket takes in a step more on either side, which is twice the rank
# error. The most values between the ends of a bracket that are fetched.
_STEPS = SIZE // 4
_FETCHED = 10_000
_ROUNDS = 40


def natural(df: DataFrame, name: str) -> Column:
    """Whole numbers as bigint, dates as days since 1970, others as double with NaN as missing."""
    kind = dict(df.dtypes)[name]
    if kind == "date":
        return F.unix_date(name).cast("bigint")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("bigint")
    return known_number(name)


def naturals(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    return df.select(*by, *[natural(df, c).alias(c) for c in columns])


def _kind(df: DataFrame, column: str) -> str:
    return dict(df.dtypes)[column]  # bigint or double


def sketch_state(base: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per ``by``: rows, and for each column its number of values, least, largest, sum and sketch.

    ``base`` holds natural values (see ``naturals``). The tasks sketch their own rows first.
    """
    sketch = {"bigint": F.kll_sketch_agg_bigint, "double": F.kll_sketch_agg_double}
    parts: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for c in columns:
        parts += [
            F.count(c).alias(f"n_{c}"),
            F.min(c).alias(f"min_{c}"),
            F.max(c).alias(f"max_{c}"),
            F.sum(F.col(c).cast("double")).alias(f"sum_{c}"),
            sketch[_kind(base, c)](c, F.lit(SIZE)).alias(f"sketch_{c}"),
        ]
    return base.groupBy(*by).agg(*parts)


def merge_sketches(state: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The state of everything together, or of each ``by``; it merges again."""
    merge = {"bigint": F.kll_merge_agg_bigint, "double": F.kll_merge_agg_double}
    parts: list[Column] = [F.sum("rows").alias("rows")]
    for c in columns:
        parts += [
            F.sum(f"n_{c}").alias(f"n_{c}"),
            F.min(f"min_{c}").alias(f"min_{c}"),
            F.max(f"max_{c}").alias(f"max_{c}"),
            F.sum(f"sum_{c}").alias(f"sum_{c}"),
            merge[_kind(state, f"min_{c}")](f"sketch_{c}", F.lit(SIZE)).alias(f"sketch_{c}"),
        ]
    return state.groupBy(*by).agg(*parts)


def _steps(kind: str, n: Column, sketch: Column) -> Column:
    """The values at even steps of the ranks, from the least to the largest; missing without values."""
    read = F.kll_sketch_get_quantile_bigint if kind == "bigint" else F.kll_sketch_get_quantile_double
    shares = ",".join(str(i / _STEPS) for i in range(_STEPS + 1))  # as one literal: the planner handles it once
    return F.when(n > 0, read(sketch, F.split(F.lit(shares), ",").cast("array<double>")))


def _bracket(steps: Sequence, share: float) -> tuple:
    """Two values around a share of the ranks."""
    at = share * _STEPS
    return steps[max(0, math.floor(at) - 1)], steps[min(_STEPS, math.ceil(at) + 1)]


@dataclass
class _Wanted:
    """An order statistic: the ``rank``-th smallest value (from 1) of a column, and a bracket that may hold it."""

    column: str
    kind: str
    rank: int
    least: float | int
    most: float | int
    low: float | int
    high: float | int
    value: float | int | None = None
    place: int | None = None  # among the values between the ends, of which there are so many
    among: int = 0

    def bound(self, end: float | int) -> Column:
        return F.lit(end).cast(self.kind)

    @property
    def key(self) -> tuple:
        return self.column, self.low, self.high


def _brackets(wanted: Sequence[_Wanted]) -> list[_Wanted]:
    """One of those that share a bracket."""
    return list({w.key: w for w in wanted}.values())


def _between(w: _Wanted) -> Column:
    return (F.col(w.column) > w.bound(w.low)) & (F.col(w.column) < w.bound(w.high))


def _counted(base: DataFrame, wanted: Sequence[_Wanted]) -> dict[tuple, dict]:
    """One pass over all rows: those below, at and between the ends of each bracket."""
    brackets, counts = _brackets(wanted), []
    for i, w in enumerate(brackets):
        c, low, high = F.col(w.column), w.bound(w.low), w.bound(w.high)
        counts += [
            F.count_if(c < low).alias(f"below_{i}"),
            F.count_if(c == low).alias(f"low_{i}"),
            F.count_if(_between(w)).alias(f"between_{i}"),
            F.count_if(c == high).alias(f"high_{i}"),
        ]
    row = base.agg(*counts).first()
    names = ("below", "low", "between", "high")
    return {w.key: {k: row[f"{k}_{i}"] for k in names} for i, w in enumerate(brackets)}


def _placed(w: _Wanted, m: dict) -> None:
    """Find the value, its place between the ends, or that it lies outside the bracket."""
    before = m["below"] + m["low"]
    upto = before + m["between"]
    if w.rank <= m["below"]:  # the bracket lies too high
        w.low, w.high = w.least, w.low
    elif w.rank <= before:
        w.value = w.low
    elif w.rank <= upto:
        w.place, w.among = w.rank - before, m["between"]
    elif w.rank <= upto + (m["high"] if w.low < w.high else 0):
        w.value = w.high
    else:  # it lies too low
        w.low, w.high = w.high, w.most


def _looked_at(base: DataFrame, wanted: Sequence[_Wanted]) -> None:
    """One pass over the rows between ends: values that are few are taken, others sketched for the next bracket."""
    brackets, parts = _brackets(wanted), []
    for i, w in enumerate(brackets):
        inside = F.when(_between(w), F.col(w.column))
        if w.among <= _FETCHED:
            parts.append(F.sort_array(F.collect_list(inside)).alias(f"v{i}"))
        else:
            sketch = F.kll_sketch_agg_bigint if w.kind == "bigint" else F.kll_sketch_agg_double
            parts.append(_steps(w.kind, F.count(inside), sketch(inside, F.lit(SIZE))).alias(f"v{i}"))
    some = reduce(or_, [_between(w) for w in brackets])
    row = base.filter(some).agg(*parts).first()
    found = {w.key: row[i] for i, w in enumerate(brackets)}
    for w in wanted:
        values = found[w.key]
        if w.among <= _FETCHED:
            w.value = values[w.place - 1]
        else:
            w.least, w.most = w.low, w.high
            w.low, w.high = _bracket(values, w.place / w.among)
        w.place = None


def quartiles(base: DataFrame, merged: DataFrame, columns: Sequence[str]) -> tuple[dict, dict[str, list[float | None]]]:
    """The merged state as a row without its sketches, and the exact quartiles of every column.

    ``base`` holds the natural values that ``merged`` was made of. Interpolates linearly between order
    statistics. The driver gets counts and bracket ends, and at most ``_FETCHED`` values a bracket.
    """
    plain = [F.col(k) for k in merged.columns if not k.startswith("sketch_")]
    steps = [_steps(_kind(base, c), F.col(f"n_{c}"), F.col(f"sketch_{c}")).alias(f"steps_{c}") for c in columns]
    known = merged.select(*plain, *steps).first().asDict()
    wanted: list[_Wanted] = []
    asked: dict[tuple[str, int], tuple[_Wanted, _Wanted, float]] = {}
    for c in columns:
        n = known[f"n_{c}"] or 0
        for q, (_, quarter) in enumerate(QUARTERS):
            if not n:
                continue
            place, part = divmod((n - 1) * quarter, 4)
            bracket = _bracket(known[f"steps_{c}"], quarter / 4)
            pair = [
                _Wanted(c, _kind(base, c), place + 1 + k, known[f"min_{c}"], known[f"max_{c}"], *bracket)
                for k in (0, 1 if part else 0)
            ]
            asked[c, q] = pair[0], pair[1], part / 4
            wanted += pair
    for _ in range(_ROUNDS):
        open_ = [w for w in wanted if w.value is None]
        if not open_:
            break
        counted = _counted(base, open_)
        for w in open_:
            _placed(w, counted[w.key])
        inside = [w for w in open_ if w.place is not None]
        if inside:
            _looked_at(base, inside)
    else:
        raise RuntimeError("a quartile was not found")
    def between(c: str, q: int) -> float | None:
        if (c, q) not in asked:
            return None
        a, b, part = asked[c, q]
        low, high = float(a.value), float(b.value)
        return low if low == high else low + (high - low) * part

    return known, {c: [between(c, q) for q in range(len(QUARTERS))] for c in columns}


_SUMMARY = T.StructType(
    [T.StructField("column", T.StringType()), T.StructField("n", T.LongType()), T.StructField("n_null", T.LongType())]
    + [T.StructField(k, T.DoubleType()) for k in ("min", "q1", "median", "mean", "q3", "max")]
    + [T.StructField(k, T.LongType()) for k in ("min_whole", "max_whole")]
)


def summary_of(base: DataFrame, merged: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, min, quartiles, mean and max per column, a row each."""
    known, found = quartiles(base, merged, columns)
    rows = []
    for c in columns:
        n, low, high = known[f"n_{c}"] or 0, known[f"min_{c}"], known[f"max_{c}"]
        whole = (low, high) if _kind(base, c) == "bigint" else (None, None)
        q1, median, q3 = found[c]
        ends = [None if x is None else float(x) for x in (low, high)]
        mean = known[f"sum_{c}"] / n if n else None
        rows.append((c, n, (known["rows"] or 0) - n, ends[0], q1, median, mean, q3, ends[1], *whole))
    return base.sparkSession.createDataFrame(rows, _SUMMARY)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, missing, min, quartiles, mean and max per column.

    The columns are written once, and everything is taken from them, so the input is read once whatever
    it costs. Quartiles are exact, with linear interpolation between order statistics; ranks are compared on
    the values themselves: whole numbers stay whole, also beyond 2^53. ``min_whole`` and ``max_whole``
    give their exact ends. The passes run when this is called.
    """
    base = stage(naturals(df, columns))
    return summary_of(base, sketch_state(base, columns), columns)


def summary_of_parts(
    base: DataFrame, state: DataFrame, columns: Sequence[str], by: str, parts: Iterable
) -> DataFrame:
    """The summary of some parts from their stored sketches; only their rows are passed over.

    ``state`` is a ``sketch_state`` per ``by`` of ``base``, both stored, best partitioned by ``by``.
    """
    chosen = F.col(by).isin(list(parts))
    return summary_of(base.filter(chosen), merge_sketches(state.filter(chosen), columns), columns)
