"""Exact quantiles of groups of any size, by narrowing the range in which each wanted position lies.

The built-in exact percentile keeps a group's whole value map in one task, and sorting the values moves all of them. Here
only sums, sketches and counts move, all of them combined in each task before the shuffle:

1. One pass takes each group's size, sum and range, and a sketch of its values at a grid of ranks.
2. The sketch gives a narrow range around each wanted position: some 0.3 % of the values.
3. A last pass counts the values inside the ranges by value, and those between the ranges together, and the positions are
   picked from the counts. Should a position lie outside of its range, the query fails; it never returns another value.

With more rounds, steps 1 and 2 are repeated inside the ranges, whose values are counted exactly each time. Everything is
one plan: no job runs while it is built, and nothing is written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from keyspan.functions.skew import attach

# Ranks of the grid, and the relative rank error of the sketch; an error below the grid's step keeps ranges right.
GRID = 1000
ACCURACY = 10_000
TOTALS = ("_n", "_nulls", "_sum", "_min", "_max")
INSIDE, BETWEEN, NO_VALUE = 0, 1, 2


def _grid(value: Column) -> Column:
    """Approximate values at GRID + 1 evenly spaced ranks; NULL without values."""
    # One text instead of a literal for each rank keeps the plan small.
    ranks = F.split(F.lit(" ".join(str(i / GRID) for i in range(GRID + 1))), " ").cast("array<double>")
    return F.percentile_approx(value, ranks, ACCURACY)


class _Place:
    """The columns of one wanted position: the edges of its range, and how many values are below and inside it."""

    def __init__(self, number: int, probability: float):
        self.from_, self.upto = f"_from_{number}", f"_upto_{number}"
        self.less, self.inside, self.grid = f"_less_{number}", f"_inside_{number}", f"_grid_{number}"
        self.position = F.expr(f"(_n - 1) * {float(probability)!r}D")
        self.first, self.last = F.floor(self.position), F.ceil(self.position)

    def holds(self) -> Column:
        return F.expr(f"_value BETWEEN {self.from_} AND {self.upto}")

    def whole(self) -> list[Column]:
        """The range of all values."""
        return [F.col("_min").alias(self.from_), F.col("_max").alias(self.upto)]

    def cut(self, grid: str, below: str, size: str) -> list[Column]:
        """Edges a step of the grid or two away from the position, which is `below` places into `size` values."""

        def at(rank: Column, steps: int) -> Column:
            step = F.floor((rank - F.expr(below)) * GRID / F.expr(f"nullif({size}, 0)")) + steps
            return F.get(F.col(grid), F.least(F.greatest(step, F.lit(0)), F.lit(GRID)).cast("int"))

        return [at(self.first, -1).alias(self.from_), at(self.last, 2).alias(self.upto)]

    def counts(self) -> list[Column]:
        return [
            F.count_if(F.expr(f"_value < {self.from_}")).alias(self.less),
            F.count_if(self.holds()).alias(self.inside),
            _grid(F.when(self.holds(), F.col("_value"))).alias(self.grid),
        ]


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: Column,
    probabilities: Mapping[str, float],
    rounds: int = 1,
    few_groups: bool = False,
) -> DataFrame:
    """Quantiles by linear interpolation, plus ``_n``, ``_sum``, ``_min``, ``_max`` and ``_nulls`` per group.

    ``probabilities`` maps output columns to probabilities. A group without any value has ``_n`` = 0 and NULL quantiles.
    ``few_groups`` says that the number of groups has a known, small bound: their ranges are then broadcast. Otherwise
    Spark picks the join, whose uneven partitions adaptive execution splits.
    """
    rows = df.select(*keys, value.alias("_value"))
    places = {name: _Place(i, probability) for i, (name, probability) in enumerate(probabilities.items())}
    edges = [name for place in places.values() for name in (place.from_, place.upto)]
    groups = rows.groupBy(*keys).agg(
        F.count("_value").alias("_n"),
        F.count_if(F.col("_value").isNull()).alias("_nulls"),
        F.sum("_value").alias("_sum"),
        F.min("_value").alias("_min"),
        F.max("_value").alias("_max"),
        *([_grid(F.col("_value")).alias("_grid")] if rounds else []),
    )
    groups = groups.select(
        *keys, *TOTALS, *[c for place in places.values() for c in (place.cut("_grid", "0", "_n") if rounds else place.whole())]
    )
    for _ in range(1, rounds):
        groups = _narrowed(rows, groups, keys, list(places.values()), few_groups)
    return _picked(rows, groups.select(*keys, *TOTALS, *edges), keys, places, few_groups)


def _narrowed(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], places: Sequence[_Place], few: bool
) -> DataFrame:
    """``groups`` with narrower ranges: counts and a sketch of the values inside of the ranges so far."""
    placed = attach(rows, groups, keys, small=few)
    counts = [count for place in places for count in place.counts()]
    found = placed.groupBy(*keys).agg(*[F.max(name).alias(name) for name in TOTALS], *counts)
    return found.select(*keys, *TOTALS, *[c for place in places for c in place.cut(place.grid, place.less, place.inside)])


def _picked(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], places: Mapping[str, _Place], few: bool
) -> DataFrame:
    inside = F.lit(False)
    for place in places.values():
        inside = inside | place.holds()
    # A value between the ranges counts with the others behind the last range before it.
    behind = [F.when(F.expr(f"_value > {place.upto}"), F.col(place.upto)) for place in places.values()]
    behind = F.greatest(*behind, *behind[:1])
    kind = F.when(F.col("_value").isNull(), NO_VALUE).when(inside, INSIDE).otherwise(BETWEEN)
    placed = attach(rows, groups, keys, small=few).select(
        *keys, *TOTALS, kind.alias("_kind"), F.when(inside, F.col("_value")).otherwise(behind).alias("_value")
    )
    counts = placed.groupBy(*keys, "_kind", "_value").agg(
        F.count(F.lit(1)).alias("_count"), *[F.max(name).alias(name) for name in TOTALS]
    )
    upto = (
        Window.partitionBy(*keys)
        .orderBy(F.col("_kind") == NO_VALUE, F.col("_value").asc_nulls_first(), "_kind")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    counts = counts.withColumn("_end", F.sum("_count").over(upto))
    picks, results = [F.max(name).alias(name) for name in TOTALS], []
    for name, place in places.items():
        for side, rank in (("lo", place.first), ("hi", place.last)):
            here = (F.col("_kind") == INSIDE) & (rank < F.col("_end")) & (rank >= F.col("_end") - F.col("_count"))
            picks.append(F.max(F.when(here, F.col("_value"))).alias(f"_{side}_{name}"))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        part = place.position - place.first
        missed = (F.col("_n") > 0) & (low.isNull() | high.isNull())
        # Equal edges are returned as they are, so that infinite values stay defined.
        results.append(
            F.when(missed, F.raise_error(F.lit("a quantile lies outside of its range")).cast("double"))
            .when(low == high, low)
            .otherwise(low + part * (high - low))
            .alias(name)
        )
    totals = [F.coalesce(F.col(name), F.lit(0)).alias(name) if name in ("_n", "_nulls") else F.col(name) for name in TOTALS]
    return counts.groupBy(*keys).agg(*picks).select(*keys, *results, *totals)
