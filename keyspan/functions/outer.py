"""A full outer join that stays even when keys are very uneven or missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from keyspan.functions.expressions import null_safe
from keyspan.functions.skew import HOT_KEYS

ROWS, COLUMNS, BOTH = "_outer_rows", "_outer_columns", "_outer_both"
ROW, COLUMN, HERE = "_outer_row", "_outer_column", "_outer_here"


def full_outer(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    hot_rows: int,
    left_id: Sequence[str] | None = None,
    right_id: Sequence[str] | None = None,
) -> DataFrame:
    """All pairs of rows with equal keys, and every row of either side that has no partner, once.

    NULL keys equal NULL keys. Columns: the keys, the other columns of ``left``, those of ``right``; the other
    columns' names must differ, and none may start with ``_outer_``. Empty sides, repeated rows and ties are
    defined by the first sentence.

    A key with more than ``hot_rows`` rows on a side becomes a grid: its left rows are dealt to
    ceil(left rows / ``hot_rows``) lines and copied to every column, its right rows are dealt to
    ceil(right rows / ``hot_rows``) columns and copied to every line, so that each pair meets in one cell. Other
    keys have one cell. One shuffle of each side by (keys, cell) then serves all keys: outer joins are not split
    by adaptive execution. A cell without rows of one side would leave rows of the other without a partner that
    they have in another cell; where a key has rows on both sides such rows are taken out again. The
    number of copies is at most the larger side's rows, or output rows / ``hot_rows`` where both sides are hot.

    Rows are dealt by a hash of ``left_id`` and ``right_id`` (all columns by default), so that a task that runs again
    deals them alike; rows equal in all of these share a line or column. Sizes are counted with a combine before
    the shuffle; the list that is broadcast has no more than ``HOT_KEYS`` keys, the largest.
    """
    clash = set(left.columns) & set(right.columns) - set(keys)
    if clash:
        raise ValueError(f"both sides have columns {sorted(clash)}")
    hot = _grids(left, right, keys, hot_rows)
    dealt_left = _dealt(left, hot, keys, left_id, own=(ROW, ROWS), other=(COLUMN, COLUMNS))
    dealt_right = _dealt(right, hot, keys, right_id, own=(COLUMN, COLUMNS), other=(ROW, ROWS))
    place = [*keys, ROW, COLUMN, HERE, BOTH]
    named = dealt_right.withColumnsRenamed({name: "_outer_r_" + name for name in place})
    joined = dealt_left.join(named, null_safe([*keys, ROW, COLUMN], "_outer_r_"), "full")
    no_left, no_right = F.col(HERE).isNull(), F.col("_outer_r_" + HERE).isNull()
    elsewhere = (no_right & F.col(BOTH)) | (no_left & F.col("_outer_r_" + BOTH))
    found = joined.filter(~F.coalesce(elsewhere, F.lit(False)))
    return found.select(
        *[F.when(no_left, F.col("_outer_r_" + key)).otherwise(F.col(key)).alias(key) for key in keys],
        *[name for name in left.columns if name not in keys],
        *[name for name in right.columns if name not in keys],
    )


def _grids(left: DataFrame, right: DataFrame, keys: Sequence[str], hot_rows: int) -> DataFrame:
    """The largest keys that are hot on a side, with the lines and columns of their grids."""
    on_left = left.select(*keys, F.lit(1).alias("_outer_l"), F.lit(0).alias("_outer_r"))
    on_right = right.select(*keys, F.lit(0).alias("_outer_l"), F.lit(1).alias("_outer_r"))
    sizes = on_left.unionByName(on_right).groupBy(*keys).agg(
        F.sum("_outer_l").alias("_outer_l"), F.sum("_outer_r").alias("_outer_r")
    )
    largest = F.greatest("_outer_l", "_outer_r")
    hot = sizes.filter(largest > hot_rows).orderBy(largest.desc(), *keys).limit(HOT_KEYS)

    def pieces(rows: str) -> Column:
        return F.greatest(F.ceil(F.col(rows) / hot_rows), F.lit(1)).cast("int")

    return hot.select(
        *[F.col(key).alias("_outer_h_" + key) for key in keys],
        pieces("_outer_l").alias(ROWS),
        pieces("_outer_r").alias(COLUMNS),
        ((F.col("_outer_l") > 0) & (F.col("_outer_r") > 0)).alias(BOTH),
    )


def _dealt(
    df: DataFrame, hot: DataFrame, keys: Sequence[str], ids: Sequence[str] | None, own: tuple[str, str], other: tuple[str, str]
) -> DataFrame:
    """Rows with their cells: dealt along the own side of the grid, copied along the other."""
    listed = df.join(F.broadcast(hot), null_safe(keys, "_outer_h_"), "left")
    one = F.lit(1)
    number = F.pmod(F.xxhash64(*(ids or df.columns)), F.coalesce(own[1], one)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(other[1], one) - 1))
    return listed.select(
        *df.columns,
        number.alias(own[0]),
        copies.alias(other[0]),
        F.lit(True).alias(HERE),
        F.coalesce(BOTH, F.lit(False)).alias(BOTH),
    )
