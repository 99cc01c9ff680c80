"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame, keep: list, array: Column | str, item: str, pos: str = "pos") -> DataFrame:
    """One row per array element with its position.

    Plain posexplode lets the optimizer add a filter on the array's size below it, which works
    out an expensive array twice; the outer form with a filter above does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.where(F.col(pos).isNotNull())


def spread_fields(df: DataFrame, keep: list, structs: Column) -> DataFrame:
    """One row per struct of the array, its fields as columns."""
    names = [c if isinstance(c, str) else df.select(c).columns[0] for c in keep]
    return spread(df, keep, structs, "_item", "_at").select(*names, "_item.*")
