"""Column expressions shared by the operators. All are Catalyst built-ins."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from keyspan.config import FIXATION, SACCADE


def is_fixation() -> Column:
    return F.col("Event_type") == FIXATION


def is_saccade() -> Column:
    return F.col("Event_type") == SACCADE


def is_other_type() -> Column:
    """True for every type but fixation and saccade, a missing type included."""
    return ~F.coalesce(F.col("Event_type").isin(FIXATION, SACCADE), F.lit(False))


def metric() -> Column:
    """Duration of a fixation, amplitude of a saccade, NULL otherwise."""
    return F.when(is_fixation(), F.col("Duration")).when(is_saccade(), F.col("Saccade_amplitude"))


def is_finite(name: str) -> Column:
    value = F.col(name)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def nan_to_null(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(float("nan")))


def category_of(categories: Mapping[str, Iterable[str]], label: str = "TOI") -> Column:
    """The category a label belongs to, for categories that do not overlap."""
    chain = F  # F.when starts a chain that Column.when continues
    for name, labels in categories.items():
        chain = chain.when(F.col(label).isin(*labels), F.lit(name))
    return chain


def categories_of(categories: Mapping[str, Iterable[str]], label: str = "TOI") -> Column:
    """All the categories a label belongs to, as an array."""
    return F.array_compact(
        F.array(*[F.when(F.col(label).isin(*labels), F.lit(name)) for name, labels in categories.items()])
    )


def with_category_order(df: DataFrame, categories: Iterable[str], column: str = "TOI_Category") -> DataFrame:
    """Add the display position of a category, counted from 1."""
    chain = F  # F.when starts a chain that Column.when continues
    for position, name in enumerate(categories, start=1):
        chain = chain.when(F.col(column) == name, F.lit(position))
    return df.withColumn("CategoryOrder", chain)


def null_safe(keys: Iterable[str], prefix: str) -> Column:
    """Join condition that matches NULL keys to NULL keys; the other side's keys carry ``prefix``."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(prefix + key))
    return condition


def ratio(total: Column, count: Column) -> Column:
    """Mean from a sum and a count; NULL for an empty set."""
    return total / F.nullif(count, F.lit(0))


def nulls_last(names: Iterable[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def first_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows of a table in a stated order, for display."""
    return df.orderBy(*nulls_last(order)).limit(n)
