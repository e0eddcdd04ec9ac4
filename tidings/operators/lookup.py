"""Lookups by key, newest rows, and the gate before enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.functions.text import preview, strip

NEWEST = 5


def by_columns(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns equal the given values; the filter reaches the file scan."""
    for name, value in values.items():
        rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def by_keys(rows: DataFrame, wanted: DataFrame, keys) -> DataFrame:
    """Bulk lookup: rows whose key occurs in ``wanted``."""
    return rows.join(wanted.select(*keys), list(keys), "left_semi")


def newest(rows: DataFrame, order: str, tie: str, title: str, n: int = NEWEST) -> DataFrame:
    """The ``n`` newest rows with a preview of the title."""
    return (
        rows.orderBy(F.desc(order), F.asc(tie))
        .limit(n)
        .select(tie, order, preview(F.col(title)).alias("preview"))
    )


def _is_empty_json(value):
    return strip(value).isin("", "{}", "[]", "null", "false", "0", '""')


def enrich_pending(
    changes: DataFrame,
    notices: DataFrame,
    done: DataFrame | None = None,
    key="id",
    extraction: str | None = "ai_extracted_json",
    reenrich_changed: bool = False,
) -> DataFrame:
    """Changed notices that still need enrichment.

    Notices that no longer exist drop out, and so do those that have a non-empty extraction
    (unless ``reenrich_changed``) and, for a feed that may deliver twice, those in ``done``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wanted = changes.select(*keys).distinct()
    if done is not None:
        wanted = wanted.join(done.select(*keys), keys, "left_anti")
    found = notices.join(wanted, keys, "left_semi")
    if extraction and not reenrich_changed:
        value = F.col(extraction)
        found = found.filter(value.isNull() | _is_empty_json(value))
    return found
