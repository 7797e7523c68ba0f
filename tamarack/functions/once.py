"""Columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns behind a one-row ``inline``.

    The optimizer substitutes plain projections into later filters and projections, which multiplies
    long expressions that build on each other. It does not look through a generator: the columns are
    evaluated once per row and are then read by name. Filters on other columns still pass below.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))))


def compiled_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """:func:`computed_once` for long expressions over many rows.

    A generator whose expressions hold a higher-order function is interpreted as a whole, and what its columns have in common is
    evaluated for each of them. Here a projection computes the struct, which is compiled and shares common parts; the generator
    only unfolds it. Compiling costs more than it gains where there are few rows.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = df.select(*rest, F.struct(*[v.alias(k) for k, v in columns.items()]).alias("_once"))
    return made.select(*rest, F.inline(F.array("_once")))
