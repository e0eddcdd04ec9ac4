"""Archiving by source and month, and the month view of dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LAYOUT = ("source_code", "month")


def month_of(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def archive(rows: DataFrame, path: str, at: str) -> None:
    """Write rows under folders of their source and month, each replaced as a whole.

    Only the months among the rows are touched, so archiving a month again gives the same files. Rows
    are rebalanced on the folders, which merges small months and splits large ones. A row without a
    time goes under the month ``none``.
    """
    placed = rows.withColumn("month", F.coalesce(month_of(F.col(at)), F.lit("none")))
    spread = placed.hint("rebalance", *(F.col(c) for c in LAYOUT)).sortWithinPartitions(*LAYOUT, at)
    writer = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*LAYOUT).parquet(path)


def read_archive(spark: SparkSession, path: str, schema: str, months=None, sources=None) -> DataFrame:
    """Archived rows; months and sources choose folders, no others are opened."""
    rows = spark.read.schema(f"{schema}, month string").parquet(path)
    if months is not None:
        rows = rows.filter(F.col("month").isin(*months))
    return rows if sources is None else rows.filter(F.col("source_code").isin(*sources))


def compact(spark: SparkSession, path: str, schema: str, at: str, months) -> None:
    """Rewrite months that have come to hold many small files."""
    from tidings.session import staged

    archive(staged(read_archive(spark, path, schema, months)).drop("month"), path, at)


def month_view(spans: DataFrame, first: str, until: str) -> DataFrame:
    """``spans`` (start_at, end_at, further columns) once for each ``month`` they touch.

    Spans are half open: one that ends as a month begins is not in it; without an end, or one that is
    not after its start, a span is the moment it starts. Months from ``first`` until before ``until``
    (their first days). The months of a span are counted out in its row; spans are not compared with months.
    """
    low, high = F.lit(first).cast("date"), F.lit(until).cast("date")
    start = F.col("start_at").cast("timestamp")
    end = F.col("end_at").cast("timestamp")
    last = F.when(end > start, end - F.expr("INTERVAL 1 MICROSECOND")).otherwise(start)
    from_ = F.greatest(F.trunc(start, "month"), F.trunc(low, "month"))
    to = F.least(F.trunc(last, "month"), F.add_months(F.trunc(high, "month"), -1))
    inside = spans.filter(start.isNotNull() & (from_ <= to))
    months = F.sequence(from_, to, F.expr("INTERVAL 1 MONTH"))
    return inside.select("*", F.explode(months).alias("month"))
