"""Exact order statistics.

``percentile_disc`` and ``percentile`` keep every distinct value of a column in one
buffer. That is right for columns with few distinct values and wrong for a
near-unique measure over billions of rows. ``order_statistics`` narrows such a column
down with approximate percentiles first: each round brackets the wanted rank between
two pivots, counts exactly what lies outside, and goes on inside. Only when what is
left is small does the exact built-in see it. No row is moved and no column is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loofold.functions.scalars import quoted
from loofold.session import written_table

EXACT_ROWS = 100_000
ACCURACY = 10_000


def lower_median(column: str) -> Column:
    """Aggregate: the lower middle value of the non-null values.

    For columns in the categorical role, whose distinct values are few.
    """
    return percentile_disc(quoted(column), 0.5)


def middle_median(column: str) -> Column:
    """Aggregate: the median that averages the two middle values."""
    return F.median(F.col(quoted(column)))


def percentile_disc(expression: str, p: float | list[float]) -> Column:
    """The SQL aggregate; it has no counterpart in ``pyspark.sql.functions``."""
    shares = f"array({', '.join(f'{x!r}D' for x in p)})" if isinstance(p, list) else f"{p!r}D"
    return F.expr(f"percentile_disc({shares}) WITHIN GROUP (ORDER BY {expression})")


@dataclass
class _Target:
    column: str
    rank: int
    below: int = 0
    inside: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def values_inside(self) -> str:
        """SQL text of the column, null outside the open range."""
        c = quoted(self.column)
        keep = [f"{c} IS NOT NULL"]
        if self.low is not None:
            keep.append(f"{c} > double('{self.low!r}')")
        if self.high is not None:
            keep.append(f"{c} < double('{self.high!r}')")
        return f"CASE WHEN {' AND '.join(keep)} THEN {c} END"


def order_statistics(
    df: DataFrame,
    ranks: Iterable[tuple[str, int]],
    counts: dict[str, int],
    exact_rows: int = EXACT_ROWS,
    accuracy: int = ACCURACY,
) -> dict[tuple[str, int], float]:
    """Values at 1-based ``rank`` among the non-null values of ``column``.

    ``counts`` holds the number of non-null values per column. The driver sees a few
    numbers per target and round; each round shrinks a range about ``accuracy`` / 4 fold.
    """
    targets = [_Target(c, k, inside=counts[c]) for c, k in dict.fromkeys(ranks)]
    open_targets = list(targets)
    while open_targets:
        # Targets with the same open range share one aggregate.
        ranges: dict[str, list[_Target]] = {}
        for t in open_targets:
            ranges.setdefault(t.values_inside(), []).append(t)
        bracket = []
        for i, (values, group) in enumerate(ranges.items()):
            shares = [(t.rank - t.below - 0.5) / t.inside for t in group]
            if group[0].inside <= exact_rows:
                bracket.append(percentile_disc(values, shares).alias(f"r{i}"))
            else:
                margin = 2.0 / accuracy
                ends = [min(max(x + m, 0.0), 1.0) for x in shares for m in (-margin, margin)]
                bracket.append(F.percentile_approx(F.expr(values), ends, accuracy).alias(f"r{i}"))
        first = df.agg(*bracket).first()
        large: list[tuple[_Target, str, float, float]] = []
        for i, (values, group) in enumerate(ranges.items()):
            found = [float(v) for v in first[f"r{i}"]]
            if group[0].inside <= exact_rows:
                for t, value in zip(group, found, strict=True):
                    t.value = value
            else:
                large += [(t, values, found[2 * j], found[2 * j + 1]) for j, t in enumerate(group)]
        if large:
            pivots = list(dict.fromkeys((values, p) for _, values, lo, hi in large for p in (lo, hi)))
            tally = []
            for i, (values, p) in enumerate(pivots):
                tally += [
                    F.count_if(F.expr(values) < F.lit(p)).alias(f"lt{i}"),
                    F.count_if(F.expr(values) <= F.lit(p)).alias(f"le{i}"),
                ]
            second = df.agg(*tally).first()
            counted = {pivot: (second[f"lt{i}"], second[f"le{i}"]) for i, pivot in enumerate(pivots)}
            for t, values, lo, hi in large:
                _narrow(t, lo, hi, *counted[values, lo], *counted[values, hi])
        open_targets = [t for t, _, _, _ in large if t.value is None]
    return {(t.column, t.rank): t.value for t in targets}


def _narrow(t: _Target, lo: float, hi: float, lt_lo: int, le_lo: int, lt_hi: int, le_hi: int) -> None:
    """Settle the target on a pivot or move its open range next to the pivots."""
    rank = t.rank - t.below
    if rank <= lt_lo:
        t.high, t.inside = lo, lt_lo
    elif rank <= le_lo:
        t.value = lo
    elif rank <= lt_hi:
        t.low, t.high, t.below, t.inside = lo, hi, t.below + le_lo, lt_hi - le_lo
    elif rank <= le_hi:
        t.value = hi
    else:
        t.low, t.below, t.inside = hi, t.below + le_hi, t.inside - le_hi


def exact_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    interpolate: bool = True,
    counts: dict[str, int] | None = None,
    exact_rows: int = EXACT_ROWS,
) -> dict[str, list[float | None]]:
    """Exact percentiles of many columns at once, interpolated or the lower value.

    Missing values must be nulls. A column without values gives nulls.
    """
    if counts is None:
        row = df.agg(*[F.count(F.col(quoted(c))).alias(f"n{i}") for i, c in enumerate(columns)]).first()
        counts = {c: row[f"n{i}"] for i, c in enumerate(columns)}
    return _percentiles(df, columns, probabilities, [interpolate], counts, exact_rows)[0]


def exact_percentile_pairs(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    counts: dict[str, int],
    exact_rows: int = EXACT_ROWS,
) -> list[dict[str, list[float | None]]]:
    """Lower values and interpolated percentiles, both from one search."""
    return _percentiles(df, columns, probabilities, [False, True], counts, exact_rows)


def _rank(p: float, n: int, interpolate: bool) -> tuple[int, int, float]:
    if interpolate:
        position = p * (n - 1)
        k = math.floor(position)
        return k + 1, min(k + 2, n), position - k
    k = max(math.ceil(p * n), 1)
    return k, k, 0.0


def _percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    kinds: Sequence[bool],
    counts: dict[str, int],
    exact_rows: int,
) -> list[dict[str, list[float | None]]]:
    wanted = {
        (c, p, kind): _rank(p, counts[c], kind) for c in columns if counts[c] for p in probabilities for kind in kinds
    }
    ranks = list(dict.fromkeys((c, k) for (c, _, _), (a, b, _) in wanted.items() for k in (a, b)))
    found = order_statistics(df, ranks, counts, exact_rows)

    def value(c: str, p: float, kind: bool) -> float | None:
        if (c, p, kind) not in wanted:
            return None
        a, b, share = wanted[c, p, kind]
        low, high = found[c, a], found[c, b]
        return low if share == 0 else low + (high - low) * share

    return [{c: [value(c, p, kind) for p in probabilities] for c in columns} for kind in kinds]


def percentiles_by(df: DataFrame, by: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact percentiles of each group: the columns ``by``, n, lower and middle (arrays by probability).

    ``lower`` is the least value that the share of rows reaches, ``middle`` interpolates. Nulls and NaN are
    left out; a group without values has no row, a null group is one of its own. All groups
    are searched at once and none is held: equal values are counted before any shuffle, distinct
    ones dealt into ranges of group and value, and ranks follow from counts before each range. So a
    group with most of the rows is spread over as many ranges as it needs.
    """
    keys = [f"__g{i}" for i in range(len(by))]
    value = F.col(quoted(column)).cast("double")
    rows = df.select(*[F.col(quoted(c)).alias(k) for c, k in zip(by, keys, strict=True)], value.alias("__value"))
    counts = rows.where(F.col("__value").isNotNull() & ~F.isnan("__value")).groupBy(*keys, "__value").agg(F.count("*").alias("__n"))
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, as ranges are drawn from a sample and must be the same for all that follows.
    dealt = written_table(counts.repartitionByRange(ranges, *keys, "__value").withColumn("__range", F.spark_partition_id()), "ranges")
    pieces = dealt.groupBy(*keys, "__range").agg(F.sum("__n").alias("__m"))  # a row per range and group in it
    group = Window.partitionBy(*keys)
    before = F.sum("__m").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.withColumns({"__before": F.coalesce(before, F.lit(0)), "__total": F.sum("__m").over(group)})
    inside = F.sum("__n").over(Window.partitionBy("__range", *keys).orderBy("__value"))
    pieces = pieces.select(*[F.col(k).alias(f"{k}p") for k in keys], F.col("__range").alias("__rangep"), "__before", "__total")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}p")) for k in keys], F.col("__range") == F.col("__rangep"))
    placed = dealt.withColumn("__end", inside).join(pieces, same).withColumn("__end", F.col("__end") + F.col("__before"))
    ranks: list[Column] = []
    for p in probabilities:
        position = F.lit(float(p)) * (F.col("__total") - 1)
        ranks += [
            F.greatest(F.ceil(F.lit(float(p)) * F.col("__total")), F.lit(1)),
            F.floor(position) + 1,
            F.least(F.floor(position) + 2, F.col("__total")),
        ]
    here = [(F.col("__end") - F.col("__n") < r) & (r <= F.col("__end")) for r in ranks]
    hits = placed.where(reduce(Column.__or__, here))
    found = hits.groupBy(*keys).agg(F.max("__total").alias("n"), *[F.max(F.when(h, F.col("__value"))).alias(f"__r{i}") for i, h in enumerate(here)])
    share = [F.lit(float(p)) * (F.col("n") - 1) - F.floor(F.lit(float(p)) * (F.col("n") - 1)) for p in probabilities]
    middle = [F.col(f"__r{3 * i + 1}") + (F.col(f"__r{3 * i + 2}") - F.col(f"__r{3 * i + 1}")) * s for i, s in enumerate(share)]
    return found.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)],
        "n",
        F.array(*[F.col(f"__r{3 * i}") for i in range(len(probabilities))]).alias("lower"),
        F.array(*middle).alias("middle"),
    )
