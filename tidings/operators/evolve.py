"""Schema changes as projections: add, drop, and tighten columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add_columns(rows: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """Add ``name -> (type, default)``; columns that exist already stay as they are."""
    new = {
        name: F.lit(default).cast(kind)
        for name, (kind, default) in columns.items()
        if name not in rows.columns
    }
    return rows.withColumns(new) if new else rows


def drop_columns(rows: DataFrame, *names: str) -> DataFrame:
    return rows.drop(*names)


def _required(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.col(name)).otherwise(
        F.raise_error(F.lit(f"null in required column {name}"))
    )


def require_columns(rows: DataFrame, *names: str) -> DataFrame:
    """Refuse nulls from here on: a job that meets one fails and names the column."""
    return rows.withColumns({n: _required(n) for n in names})
