"""Exact quantiles of whole tables without gathering them: brackets from mergeable sketches, narrowed round by round.

A quantile is the value of one rank, or lies between those of two. Each round has two scans for all ranks of all columns at
once: one sketches the values inside each rank's bracket (KLL), one counts what is below and at the two values between which
the sketch puts the rank. A rank that falls on one of these is found, so values that many rows share are no hindrance; else
the next bracket is between them, with a fiftieth of the values. What has at most FEW values, whole columns too, goes to
Spark's own exact aggregates, which hold all values that they get in one task. Besides these, nothing is shuffled but one row
of counts and sketches a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a column or bracket that one task holds, at most.
FEW = 1 << 20
#: Size of the sketches, and the error of rank that is allowed for (several times what such a sketch has).
SKETCH, ERROR = 1024, 0.01


@dataclass
class Rank:
    """A rank (from 0) of a column's values: its value, or what is known of it: it is above low and under high (both open)."""

    column: str
    rank: int
    below: int
    within: int
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        out = F.col(self.column).isNotNull()
        out = out if self.low is None else out & (F.col(self.column) > F.lit(self.low))
        return out if self.high is None else out & (F.col(self.column) < F.lit(self.high))


def exact_quantiles(df: DataFrame, columns: dict[str, Column], wanted: dict[str, list[float]], few: int = FEW) -> dict[tuple[str, float], float | None]:
    """For each column and fraction the quantile with linear interpolation; null where there are no values. Nulls and NaN do not count."""
    values = df.select(*(F.when(~F.isnan(x.cast("double")), x.cast("double")).alias(name) for name, x in columns.items()))
    counts = values.agg(*(F.count(c).alias(c) for c in columns)).first()
    out: dict[tuple[str, float], float | None] = {(c, p): None for c in columns for p in wanted.get(c, [])}
    small = [c for c in columns if wanted.get(c) and 0 < counts[c] <= few]
    if small:
        row = values.agg(*(F.percentile(c, F.array(*(F.lit(p) for p in wanted[c]))).alias(c) for c in small)).first()
        out |= {(c, p): x for c in small for p, x in zip(wanted[c], row[c])}
    places = {(c, p): p * (counts[c] - 1) for c in columns for p in wanted.get(c, []) if counts[c] > few}
    ranks = {(c, k): Rank(c, k, 0, counts[c]) for (c, _), at in places.items() for k in {math.floor(at), math.ceil(at)}}
    while open_ := [r for r in ranks.values() if r.value is None and r.within > few]:
        narrow(values, open_)
    pick(values, [r for r in ranks.values() if r.value is None])
    for (c, p), at in places.items():
        low, high = ranks[c, math.floor(at)].value, ranks[c, math.ceil(at)].value
        out[c, p] = low if low == high else low + (high - low) * (at - math.floor(at))
    return out


def narrow(values: DataFrame, ranks: list[Rank]) -> None:
    """One round."""
    about = lambda r: F.array(*(F.lit(min(1.0, max(0.0, (r.rank - r.below + 0.5) / r.within + e))) for e in (-ERROR, ERROR)))
    sketch = lambda r: F.kll_sketch_agg_double(F.when(r.inside(), F.col(r.column)), F.lit(SKETCH))
    row = values.agg(*(F.kll_sketch_get_quantile_double(sketch(r), about(r)).alias(f"q{i}") for i, r in enumerate(ranks))).first()
    tests = lambda i, r, k: (F.count_if(F.col(r.column) < F.lit(row[f"q{i}"][k])).alias(f"b{i}_{k}"), F.count_if(F.col(r.column) == F.lit(row[f"q{i}"][k])).alias(f"e{i}_{k}"))
    found = values.agg(*(x for i, r in enumerate(ranks) for k in (0, 1) for x in tests(i, r, k))).first()
    for i, r in enumerate(ranks):
        end = r.below + r.within
        for k in (0, 1):
            v, below, equal = row[f"q{i}"][k], found[f"b{i}_{k}"], found[f"e{i}_{k}"]
            if r.rank < below:
                r.high, end = v, below
                break
            if r.rank < below + equal:
                r.value = v
                break
            r.low, r.below = v, below + equal
        r.within = end - r.below


def pick(values: DataFrame, ranks: list[Rank]) -> None:
    """The values of ranks whose brackets have few."""
    if ranks:
        # The fraction is that of the middle of a rank's step, so that no rounding leads to its neighbour.
        one = lambda i, r: F.expr(f"percentile_disc({(r.rank - r.below + 0.5) / r.within!r}D) WITHIN GROUP (ORDER BY v{i})").alias(f"v{i}")
        row = values.select(*(F.when(r.inside(), F.col(r.column)).alias(f"v{i}") for i, r in enumerate(ranks))).agg(*(one(i, r) for i, r in enumerate(ranks))).first()
        for i, r in enumerate(ranks):
            r.value = row[f"v{i}"]
