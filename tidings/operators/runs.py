"""Run log: start and end of runs, and the report of recent runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.dates import iso_text
from tidings.functions.text import error_text
from tidings.schema import RUNS, conform

# States of a run and limits of the report.
RUNNING, SUCCESS, FAILED = "running", "success", "failed"
DEFAULT_LIMIT, MAX_LIMIT = 50, 200


def started_run(spark: SparkSession, source_id: int, task_id: str, started_at) -> DataFrame:
    """One new row of the run log, in state running with nothing upserted."""
    row = spark.range(1).select(
        F.xxhash64(F.lit(task_id), F.lit(started_at).cast("timestamp")).alias("id"),
        F.lit(source_id).alias("source_id"),
        F.lit(task_id).alias("task_id"),
        F.lit(started_at).alias("started_at"),
        F.lit(None).alias("finished_at"),
        F.lit(RUNNING).alias("status"),
        F.lit(0).alias("notices_upserted"),
        F.lit(None).alias("error_message"),
    )
    return conform(row, RUNS)


def update_runs(
    runs: DataFrame,
    updates: DataFrame,
    key: str = "task_id",
    order: str = "started_at",
    columns=("finished_at", "status", "notices_upserted", "error_message"),
) -> DataFrame:
    """Apply one update per task to its latest run; null values of an update change nothing.

    The latest run is found among the touched tasks only, by an aggregate that combines
    before the shuffle. Error messages are cut to the stored length.
    """
    touched = runs.join(updates.select(key), key, "left_semi")
    latest = touched.groupBy(key).agg(F.max(order).alias(order))
    renamed = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return _applied(runs, latest.join(renamed, key), [key, order], columns)


def update_attempts(
    runs: DataFrame,
    updates: DataFrame,
    keys=("task_id", "started_at"),
    columns=("finished_at", "status", "notices_upserted", "error_message"),
) -> DataFrame:
    """Apply one update per attempt to that attempt; null values of an update change nothing."""
    renamed = updates.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return _applied(runs, renamed, list(keys), columns)


def _applied(runs: DataFrame, renamed: DataFrame, keys: list[str], columns) -> DataFrame:
    joined = runs.join(renamed, keys, "left")

    def value(c: str):
        new = F.col(f"_{c}")
        new = error_text(new) if c == "error_message" else new
        return F.coalesce(new, F.col(c)).alias(c)

    return joined.select(*[value(c) if c in columns else F.col(c) for c in runs.columns])


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}")
    return limit


def recent_runs(
    runs: DataFrame, sources: DataFrame, limit: int = DEFAULT_LIMIT
) -> DataFrame:
    """The newest runs with the code of their source, times as ISO text.

    Inner join, so runs without a source do not show. The join is left to Spark's measured
    sizes; the sort and limit are one top-k step, not a full sort.
    """
    check_limit(limit)
    codes = sources.select(F.col("id").alias("source_id"), F.col("external_id").alias("source_code"))
    newest = (
        runs.join(codes, "source_id")
        .orderBy(F.desc("started_at"), F.asc("id"))
        .limit(limit)
    )
    return newest.select(
        "source_code",
        iso_text(F.col("started_at")).alias("started_at"),
        iso_text(F.col("finished_at")).alias("finished_at"),
        "status",
        "notices_upserted",
        "error_message",
    )
