"""Order statistics without sorting the rows.

A rank is closed in on by brackets: a quantile sketch of the rows still inside a bracket names two
values around the rank, one pass counts exactly what lies below, at and between them, and either an
edge is the answer or the open interval between them is the next bracket. The interval holds about
``6 / ACCURACY`` of the rows before, whatever ties there are, so a few passes suffice for any table;
the last ``SMALL`` rows or fewer are picked from an array. All passes are aggregations to one row
with map-side buffers of bounded size: no shuffle of rows, no sort, no checkpoint.

Jobs run when the functions are called, and each pass reads the frame anew, so give one that is
stored. Nulls take no part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Relative rank error of a sketch is 1 / ACCURACY; its buffer grows with ACCURACY.
ACCURACY = 4000
#: Rows that may be gathered in one array.
SMALL = 10_000


@dataclass
class _Target:
    """The value of ``column`` at 1-based ``rank``; None: there is none."""
    column: Column
    rank: int
    rows: int = 0  # inside the open bracket
    below: int = 0  # at or below its lower edge
    low: Any = None
    high: Any = None
    value: Any = None
    smaller: int = 0  # rows smaller than the value
    done: bool = False

    def inside(self) -> Column:
        c = self.column.isNotNull()
        c = c & (self.column > F.lit(self.low)) if self.low is not None else c
        return c & (self.column < F.lit(self.high)) if self.high is not None else c

    def own(self) -> Column:
        return F.when(self.inside(), self.column)

    def found(self, value, smaller: int) -> None:
        self.value, self.smaller, self.done = value, smaller, True


def _row(df: DataFrame, columns: list[Column]) -> list:
    return list(df.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def _close_in(df: DataFrame, targets: list[_Target], accuracy: int) -> None:
    """One sketch pass and one counting pass."""
    wanted = []
    for t in targets:
        k = t.rank - t.below
        wanted.append([min(max((k + side * 2 * t.rows / accuracy) / t.rows, 0.0), 1.0) for side in (-1, 1)])
    edges = _row(df, [F.percentile_approx(t.own(), F.array(*map(F.lit, w)), accuracy) for t, w in zip(targets, wanted)])
    counts = []
    for t, (a, b) in zip(targets, edges):
        c = t.own()
        counts += [F.count_if(c < F.lit(a)), F.count_if(c == F.lit(a)), F.count_if((c > F.lit(a)) & (c < F.lit(b))),
                   F.count_if(c == F.lit(b))]
    got = iter(_row(df, counts))
    for t, (a, b) in zip(targets, edges):
        under, at_a, between, at_b = (next(got) for _ in range(4))
        k = t.rank - t.below
        if k <= under:  # the sketch erred: what lies below is the bracket
            t.high, t.rows = a, under
        elif k <= under + at_a:
            t.found(a, t.below + under)
        elif k <= under + at_a + between:
            t.low, t.high, t.rows, t.below = a, b, between, t.below + under + at_a
        elif a != b and k <= under + at_a + between + at_b:
            t.found(b, t.below + under + at_a + between)
        else:
            gone = under + at_a + (between + at_b if a != b else 0)
            t.low, t.rows, t.below = b, t.rows - gone, t.below + gone


def _resolve(df: DataFrame, targets: list[_Target], small: int, accuracy: int) -> None:
    """Fill value and smaller of targets whose rows are known."""
    while True:
        for t in targets:
            t.done = t.done or not 1 <= t.rank - t.below <= t.rows
        large = [t for t in targets if not t.done and t.rows > small]
        if not large:
            break
        _close_in(df, large, accuracy)
    rest = [t for t in targets if not t.done]
    if rest:
        for t, got in zip(rest, _row(df, [_pick(t) for t in rest])):
            t.found(got["value"], t.below + got["before"])


def _pick(t: _Target) -> Column:
    """Value at the rank and the number of smaller ones among the few rows of the bracket."""
    values = F.sort_array(F.collect_list(t.own()))
    value = F.element_at(values, t.rank - t.below)
    return F.struct(value.alias("value"), (F.array_position(values, value) - 1).alias("before"))


def values_at_ranks(df: DataFrame, column: str | Column, ranks: Sequence[int], *, n: int | None = None,
                    small: int = SMALL, accuracy: int = ACCURACY) -> list[tuple[Any, int]]:
    """(value at the 1-based rank, number of smaller rows) for each rank of a numeric column;
    (None, 0) for ranks that do not exist. ``n`` is the number of rows that are not null, if known."""
    c = F.col(column) if isinstance(column, str) else column
    n = _row(df, [F.count(c)])[0] if n is None else n
    targets = [_Target(c, rank, n) for rank in ranks]
    _resolve(df, targets, small, accuracy)
    return [(t.value, t.smaller) for t in targets]


def rows_at_ranks(df: DataFrame, column: str | Column, tie: str, ranks: Sequence[int], *, n: int | None = None,
                  small: int = SMALL, accuracy: int = ACCURACY) -> list[tuple[Any, Any]]:
    """(value, tie) of the rows at these ranks in the order of a numeric column and, among equal
    values, of the numeric column ``tie``. Neither may be null."""
    c = F.col(column) if isinstance(column, str) else column
    firsts = values_at_ranks(df, c, ranks, n=n, small=small, accuracy=accuracy)
    held = sorted({v for v, _ in firsts if v is not None})
    sizes = dict(zip(held, _row(df, [F.count_if(c == F.lit(v)) for v in held]))) if held else {}
    targets = [_Target(F.when(c == F.lit(v), F.col(tie)), rank - smaller, sizes.get(v, 0)) for (v, smaller), rank in zip(firsts, ranks)]
    _resolve(df, targets, small, accuracy)
    return [(v, t.value) for (v, _), t in zip(firsts, targets)]


def exact_percentiles(df: DataFrame, value: str | Column, probs: Sequence[float], *, small: int = SMALL,
                      accuracy: int = ACCURACY) -> Column:
    """Exact linearly interpolated percentiles as an ``array<double>`` column of constants.

    The definition of ``percentile``, pandas ``quantile`` and ``quantile_cont``; nulls for a column
    without values.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    n = _row(df, [F.count(v)])[0]
    ranks, shares = [], []
    for p in probs:
        h = (n - 1) * float(p)
        low = int(h // 1)
        ranks += [low + 1, min(low + 2, n)]
        shares.append(h - low)
    got = values_at_ranks(df, v, ranks, n=n, small=small, accuracy=accuracy)
    out = []
    for i, share in enumerate(shares):
        a, b = got[2 * i][0], got[2 * i + 1][0]
        out.append(F.lit(None if a is None else a + share * (b - a)).cast("double"))
    return F.array(*out)
