"""Exact quantiles of columns of any size, in two readings of the input.

The first reading sketches every column. The sketch merges, and its values are off by at most a share of 1 / ACCURACY
in rank, so two of them enclose the wanted ranks. The second reading counts the values below that bracket and adds up
the equal ones inside it, map-side first. What is inside, about 10 / ACCURACY of the values, is written, and running
sums over it give the value at each rank; only those reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskflow.operators.ordered import MAX_GROUP_ROWS, Agg, running, written

#: A column with no more values than this is its own bracket.
SMALL_BRACKET = 100_000
ACCURACY = 100_000
#: On either side of the wanted share: the sketch's own error, and the ranks next to the share.
_MARGIN = 4 / ACCURACY


@dataclass
class _Bracket:
    """The values of a column from low to high (None: open), and the place looked for: ranks on both its sides."""

    column: str
    low: float | None
    high: float | None
    place: float

    @property
    def ranks(self) -> set[int]:
        return {math.floor(self.place), math.ceil(self.place)}

    def cell(self, number: int) -> Column:
        """Number and value of a value inside, number and null of one below, null of one above and of a null."""
        v = F.col(self.column)
        inside = F.lit(True) if self.low is None else v >= self.low
        taken = v.isNotNull() if self.high is None else v <= self.high
        return F.when(taken, F.struct(F.lit(number).alias("bracket"), F.when(inside, v).alias("v")))


def _sketched(data: DataFrame, wanted: dict[str, float]) -> list[_Bracket]:
    """One reading: the bracket of each column that has values. NaN is sketched as infinity, below which it never lies."""
    aggs = []
    for i, (c, q) in enumerate(wanted.items()):
        sides = [max(0.0, q - _MARGIN), min(1.0, q + _MARGIN)]
        finite = F.when(F.isnan(c), F.lit(math.inf)).otherwise(F.col(c))
        aggs += [F.count(c).alias(f"n{i}"), F.percentile_approx(finite, sides, ACCURACY).alias(f"s{i}")]
    got = data.agg(*aggs).first()
    out = []
    for i, (c, q) in enumerate(wanted.items()):
        n = got[f"n{i}"]
        if n:
            low, high = (None, None) if n <= SMALL_BRACKET else got[f"s{i}"]
            out.append(_Bracket(c, low, None if high == math.inf else high, q * (n - 1)))
    return out


def _settled(data: DataFrame, brackets: list[_Bracket]) -> tuple[dict[tuple[str, int], float], list[_Bracket]]:
    """One reading: the values at the ranks, and brackets opened on the side where they missed a rank."""
    cells = data.select(F.explode(F.array(*[b.cell(i) for i, b in enumerate(brackets)])).alias("c")).filter("c IS NOT NULL")
    values = written(cells.select("c.*").groupBy("bracket", "v").agg(F.count("*").alias("n")), "brackets")
    below, inside, distinct = {}, {}, {}
    for r in values.groupBy("bracket").agg(
            F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"),
            F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("inside"), F.count("v").alias("distinct")).collect():
        below[r.bracket], inside[r.bracket], distinct[r.bracket] = r.below or 0, r.inside or 0, r.distinct
    hits, missed = [], []
    for i, b in enumerate(brackets):
        under, upto = below.get(i, 0), below.get(i, 0) + inside.get(i, 0)
        hits += [(i, r - under) for r in sorted(b.ranks) if under <= r < upto]
        lost = {r for r in b.ranks if not under <= r < upto}
        if lost:
            missed.append(_Bracket(
                b.column, None if min(lost) < under else b.low, None if max(lost) >= upto else b.high, b.place))
    found = {}
    if hits:
        large = None if max(distinct.values()) <= MAX_GROUP_ROWS else "measure"
        start = F.coalesce("_before", F.lit(0))
        at = running(
            values.filter("v IS NOT NULL"), ["bracket"], ["v"], {"_before": Agg("sum", F.col("n"))}, large=large, max_rows=MAX_GROUP_ROWS)
        here = F.array(*[F.struct(F.lit(i).alias("bracket"), F.lit(r).alias("rank")) for i, r in hits])
        mine = F.filter(here, lambda h: (h["bracket"] == F.col("bracket")) & (h["rank"] >= start) & (h["rank"] < start + F.col("n")))
        for r in at.select("v", F.explode(mine).alias("h")).collect():
            b = brackets[r.h.bracket]
            found[b.column, r.h.rank + below[r.h.bracket]] = r.v
    return found, missed


def exact_quantiles(df: DataFrame, wanted: dict[str, float]) -> dict[str, float | None]:
    """The wanted quantile of each column, with linear interpolation between neighbouring values; nulls are
    left out, NaN is above all numbers, a column without values has none.

    Should a sketch break its bound, the bracket is opened and the input read once more.
    """
    if not wanted:
        return {}
    data = df.select(*[F.col(c).cast("double").alias(c) for c in wanted])
    brackets = _sketched(data, wanted)
    places = {b.column: b.place for b in brackets}
    at: dict[tuple[str, int], float] = {}
    while brackets:
        found, brackets = _settled(data, brackets)
        at |= found
    out: dict[str, float | None] = dict.fromkeys(wanted)
    for c, place in places.items():
        a, b = at[c, math.floor(place)], at[c, math.ceil(place)]
        out[c] = a if a == b else a + (b - a) * (place - math.floor(place))
    return out


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    return exact_quantiles(df, {column: q})[column]


def fit_caps(df: DataFrame, columns: list[str], q: float = 0.99) -> dict[str, float]:
    """Upper caps of the given uncapped columns."""
    return exact_quantiles(df, dict.fromkeys(columns, q))


def median(df: DataFrame, column: str) -> float | None:
    return exact_quantile(df, column, 0.5)
