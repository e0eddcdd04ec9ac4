"""Paged listing by cursor, over a copy of the rows that is clustered in the order of the pages.

A page starts after the last row of the one before it, named by its sort key, so no rows are counted
off. The copy's files hold ranges of the order, and a small table holds each file's bounds: a page
reads the one or two files it lies in, however deep it is.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file at most.
FILE_ROWS = 100_000


def sort_key(*parts: tuple[Column, bool]) -> Column:
    """One comparable value of several columns of whole numbers, dates or times; True is descending."""
    fields = []
    for k, (column, descending) in enumerate(parts):
        number = F.coalesce(column, F.lit(-(1 << 62)))
        fields.append((-number if descending else number).cast("long").alias(f"k{k}"))
    return F.struct(*fields)


def write_listing(rows: DataFrame, path: str, key: Column, file_rows: int = FILE_ROWS) -> None:
    """A copy of the rows in the order of ``key``, and the bounds of its files."""
    total = rows.count()
    keyed = rows.withColumn("listing_key", key)
    files = max(1, -(-total // file_rows))
    ordered = keyed.repartitionByRange(files, "listing_key").sortWithinPartitions("listing_key")
    ordered.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(f"{path}/rows")
    bounds = rows.sparkSession.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file")).agg(
        F.min("listing_key").alias("first"), F.max("listing_key").alias("last"), F.count("*").alias("n")
    )
    bounds.coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def _after(cursor: str | None, key: Column, names) -> Column:
    if cursor is None:
        return F.lit(True)
    values = [F.lit(v).cast("long").alias(n) for v, n in zip(json.loads(cursor), names, strict=True)]
    return key > F.struct(*values)


def page(spark: SparkSession, path: str, size: int, cursor: str | None = None) -> DataFrame:
    """The ``size`` rows after the cursor, in order, each with ``cursor``, that of the page after it."""
    bounds = spark.read.parquet(f"{path}/bounds")
    names = bounds.schema["first"].dataType.names
    left = bounds.filter(_after(cursor, F.col("last"), names)).orderBy("first").select("file", "n")
    # The first file may be read in part; those after it count in full. One row per file is looked at.
    wanted, seen = [], None
    for row in left.toLocalIterator():
        wanted.append(row["file"])
        seen = 0 if seen is None else seen + row["n"]
        if seen >= size:
            break
    if not wanted:
        return spark.read.parquet(f"{path}/rows").limit(0).drop("listing_key").withColumn("cursor", F.lit(""))
    rows = spark.read.parquet(*wanted).filter(_after(cursor, F.col("listing_key"), names))
    text = F.to_json(F.array(*(F.col(f"listing_key.{n}") for n in names))).alias("cursor")
    return rows.orderBy("listing_key").limit(size).select("*", text).drop("listing_key")
