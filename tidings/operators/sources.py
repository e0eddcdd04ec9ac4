"""Source registry: known codes, per-source choice of an expression, unknown-code check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def per_source(code: Column, by_code: dict, default: Column | None = None) -> Column:
    """The expression that belongs to a row's source; ``default`` (null) for other codes.

    Only the branch of the row's own source is evaluated.
    """
    if not by_code:
        return default
    items = list(by_code.items())
    chosen = reduce(
        lambda acc, item: acc.when(code == item[0], item[1]),
        items[1:],
        F.when(code == items[0][0], items[0][1]),
    )
    return chosen if default is None else chosen.otherwise(default)


def registry(spark: SparkSession, sites, list_urls: dict[str, str]) -> DataFrame:
    """Registry rows ``external_id, name, list_url`` of the configured sites.

    The addresses of the lists, by code, are settings of an installation, not part of the
    rules; a site without one is not collected and has a null address.
    """
    rows = [(s.code, s.name, list_urls.get(s.code)) for s in sites]
    return spark.createDataFrame(rows, "external_id string, name string, list_url string")


def require_known(code: str, sites) -> None:
    """Refuse a code that no site rule covers."""
    codes = [s.code for s in sites]
    if code not in codes:
        raise ValueError(f"unknown source code {code!r}; known: {codes}")


def split_unknown(rows: DataFrame, sources: DataFrame, code: str = "source_code"):
    """Rows whose code is registered, and the others.

    No broadcast hint: Spark broadcasts the registry by its measured size and falls back
    to a shuffled join when it has grown.
    """
    keys = sources.select(F.col("external_id").alias(code)).distinct()
    return rows.join(keys, code, "left_semi"), rows.join(keys, code, "left_anti")


def seed_missing(existing: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """Existing rows untouched, plus the seed rows whose key is absent."""
    return existing.unionByName(
        seed.join(existing.select(key), key, "left_anti"), allowMissingColumns=True
    )
