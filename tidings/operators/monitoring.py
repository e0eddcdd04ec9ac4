"""Watching the sources: how often their contents change, and which have fallen silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Size of the sketches: 2 ** 12 registers for distinct values, and the width of the quantile sketch.
REGISTERS, WIDTH = 12, 200
#: Errors that go with these sizes, at three standard errors for distinct values and 99 % for ranks.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (REGISTERS / 2), 0.0265


def change_sketches(changes: DataFrame, value: str | None = None) -> DataFrame:
    """Per source and day: n, a sketch of the different keys, and one of the distribution of ``value``.

    ``changes`` has source_code, at, key and perhaps a number. The sketches are built where the rows
    are and merged after the shuffle; stored, they answer for any span of days.
    """
    day = F.col("at").cast("date").alias("day")
    more = [] if value is None else [F.kll_sketch_agg_double(F.col(value).cast("double"), WIDTH).alias("values")]
    return changes.groupBy("source_code", day).agg(
        F.count("*").alias("n"), F.hll_sketch_agg("key", REGISTERS).alias("keys"), *more
    )


def rolled_up(sketches: DataFrame, span: Column, quantiles=(0.5, 0.9)) -> DataFrame:
    """n, distinct keys and quantiles per source and span of days, from the sketches alone."""
    named = "values" in sketches.columns
    more = [F.kll_merge_agg_double("values").alias("values")] if named else []
    merged = sketches.groupBy("source_code", span.alias("span")).agg(
        F.sum("n").alias("n"), F.hll_union_agg("keys").alias("keys"), *more
    )
    shown = [F.kll_sketch_get_quantile_double("values", F.lit(q)).alias(f"q{round(q * 100)}") for q in quantiles if named]
    return merged.select("source_code", "span", "n", F.hll_sketch_estimate("keys").alias("n_keys"), *shown)


def failure_streaks(runs: DataFrame, least: int) -> DataFrame:
    """Runs of ``least`` or more attempts of a source in a row without a result.

    ``runs`` has source_code, started_at, id and ok. Streaks are numbered by the successes before them; the
    running count goes over the runs of a source, by partitions of its months first, so a source that
    runs very often is no single task: source_code, since, until, n_runs.
    """
    month = F.date_trunc("month", "started_at")
    rows = runs.select("source_code", "started_at", "id", F.coalesce("ok", F.lit(False)).alias("ok"), month.alias("month"))
    totals = rows.groupBy("source_code", "month").agg(F.count_if("ok").alias("ok_in_month"))
    earlier = Window.partitionBy("source_code").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source_code", "month", F.coalesce(F.sum("ok_in_month").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_code", "month").orderBy("started_at", "id")
    count = F.sum(F.col("ok").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = rows.withColumn("inside", count).join(bases, ["source_code", "month"])
    streak = (F.col("base") + F.col("inside")).alias("streak")
    silent = numbered.filter(~F.col("ok")).groupBy("source_code", streak).agg(
        F.min("started_at").alias("since"), F.max("started_at").alias("until"), F.count("*").alias("n_runs")
    )
    return silent.filter(F.col("n_runs") >= least).drop("streak")


def silent_sources(sources: DataFrame, runs: DataFrame, now, limit_days: int, least: int = 3) -> DataFrame:
    """Sources whose last success is older than ``limit_days`` or which have never had one, or whose last
    ``least`` runs all came without result: source_code, last_success, n_streak, reason.
    """
    known = runs.filter(F.col("ok")).groupBy("source_code").agg(F.max("started_at").alias("last_success"))
    late = runs.join(known, "source_code", "left").filter(
        F.col("last_success").isNull() | (F.col("started_at") > F.col("last_success"))
    )
    streaks = late.filter(~F.coalesce("ok", F.lit(False))).groupBy("source_code").agg(F.count("*").alias("n_streak"))
    at = F.lit(now).cast("timestamp")
    seen = sources.select("source_code").join(known, "source_code", "left").join(streaks, "source_code", "left")
    n = F.coalesce("n_streak", F.lit(0))
    old = F.col("last_success") < at - F.make_dt_interval(F.lit(limit_days))
    reason = F.when(F.col("last_success").isNull(), "never").when(old, "silent").when(n >= least, "failing")
    return seen.select("source_code", "last_success", n.alias("n_streak"), reason.alias("reason")).filter(
        "reason IS NOT NULL"
    )


ALARMS = "source_code string, last_success timestamp"


def silence_alarms(runs: DataFrame, limit_days: int, delay: str = "1 day") -> DataFrame:
    """Stream of alarms: a source whose successes stop for ``limit_days`` of event time, once per silence.

    ``runs`` is a stream of source_code, started_at and ok. The state of a source is its newest success; a
    timer on event time fires when the watermark has passed it by the limit.
    """
    limit = pd.Timedelta(days=limit_days)

    def watch(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"source_code": [key[0]], "last_success": [pd.Timestamp(last, unit="us")]})
            return
        last = state.get[0] if state.exists else None
        for batch in batches:
            newest = batch.loc[batch["ok"].fillna(False).astype(bool), "started_at"].max()
            if not pd.isna(newest):
                micros = newest.value // 1000
                last = micros if last is None else max(last, micros)
        if last is not None:
            state.update((last,))
            due = int((pd.Timestamp(last, unit="us") + limit).value // 1_000_000)
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    watched = runs.withWatermark("started_at", delay).groupBy("source_code")
    return watched.applyInPandasWithState(watch, ALARMS, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
