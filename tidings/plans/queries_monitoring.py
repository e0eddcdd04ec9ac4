"""Queries over listings, use and runs: history, activation, change frequency, silence."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators.history import notice_history
from tidings.operators.monitoring import (
    DISTINCT_ERROR,
    RANK_ERROR,
    change_sketches,
    failure_streaks,
    rolled_up,
    silent_sources,
)
from tidings.operators.usage import activation_rates
from tidings.plans.catalog import query, table
from tidings.session import staged

# --- history: users are what is listed, types of events the sources; every fifth day is incomplete


def _sightings(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_type").alias("source_code"),
        F.col("user_id").cast("string").alias("external_id"),
        F.col("ts").cast("date").alias("day"),
    )


@query(
    "notice_history",
    """
    WITH s AS (SELECT DISTINCT event_type AS source_code, user_id, ts::DATE AS day FROM events),
    full_ AS (SELECT DISTINCT source_code, day FROM s WHERE day(day) % 5 <> 0),
    ended AS (
      SELECT s.*, (SELECT min(f.day) FROM full_ f WHERE f.source_code = s.source_code AND f.day > s.day) AS next_full,
        lead(day) OVER w AS next_day FROM s WINDOW w AS (PARTITION BY source_code, user_id ORDER BY day)),
    marked AS (
      SELECT *, next_full IS NOT NULL AND (next_day IS NULL OR next_day > next_full) AS ends FROM ended),
    placed AS (
      SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY source_code, user_id ORDER BY day
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM marked)
    SELECT source_code, CAST(user_id AS VARCHAR) AS external_id, min(day) AS valid_from,
      max(CASE WHEN ends THEN next_full END) AS valid_to
    FROM placed GROUP BY source_code, user_id, island
    """,
)
def history(spark, sf):
    """When every notice was listed, gone and back."""
    seen = _sightings(spark, sf)
    listings = seen.select("source_code", "day").distinct().withColumn("complete", F.dayofmonth("day") % 5 != 0)
    return notice_history(seen, listings)


_DAYS = 7


@query(
    "activation_rate",
    f"""
    WITH joined AS (
      SELECT user_id, min(ts::DATE) AS joined FROM events WHERE event_type = 'signup' GROUP BY user_id),
    began AS (
      SELECT user_id, joined, (SELECT min(date_diff('day', joined, e.ts::DATE)) FROM events e
        WHERE e.user_id = j.user_id AND event_type = 'click' AND e.ts::DATE >= joined
          AND e.ts::DATE < joined + {_DAYS}) AS after FROM joined j),
    cohorts AS (
      SELECT *, DATE '1970-01-01' + CAST(floor(date_diff('day', DATE '1970-01-01', joined) / 7) * 7 AS INT) AS cohort
      FROM began)
    SELECT cohort, within, count(*) AS users, count(*) FILTER (after <= within) AS activated,
      round(count(*) FILTER (after <= within) / count(*), 6) AS rate
    FROM cohorts, (SELECT unnest(range({_DAYS}))::INT AS within) GROUP BY cohort, within
    """,
)
def activation_rate(spark, sf):
    """Users who click within a week of signing up, by cohort and day."""
    events = table(spark, sf, "events").select("user_id", F.col("ts").alias("at"), "event_type")
    of = lambda kind: events.filter(F.col("event_type") == kind)
    return activation_rates(of("signup"), of("click"), _DAYS)


@query(
    "change_frequency",
    """
    SELECT event_type AS source_code, date_trunc('week', ts)::DATE AS span, count(*) AS n,
      count(DISTINCT user_id) AS exact_keys, true AS keys_within, true AS median_within
    FROM events GROUP BY ALL
    """,
)
def change_frequency(spark, sf):
    """Weekly changes and different notices per source, rolled up from daily sketches, against exact counts."""
    changes = table(spark, sf, "events").select(
        F.col("event_type").alias("source_code"), F.col("ts").alias("at"), F.col("user_id").alias("key"), "value"
    )
    weekly = staged(rolled_up(staged(change_sketches(changes, "value")), F.date_trunc("week", "day").cast("date")))
    week = F.date_trunc("week", "at").cast("date").alias("span")
    rows = changes.select("source_code", week, "key", "value")
    median = weekly.select("source_code", "span", "q50")
    exact = rows.join(median, ["source_code", "span"]).groupBy("source_code", "span").agg(
        F.countDistinct("key").alias("exact_keys"),
        F.avg((F.col("value") < F.col("q50")).cast("int")).alias("below"),
        F.avg((F.col("value") <= F.col("q50")).cast("int")).alias("upto"),
    )
    both = weekly.join(exact, ["source_code", "span"])
    error = F.abs(F.col("n_keys") - F.col("exact_keys"))
    rank_near = (F.col("below") <= 0.5 + RANK_ERROR) & (F.col("upto") >= 0.5 - RANK_ERROR)
    return both.select(
        "source_code",
        "span",
        "n",
        "exact_keys",
        (error <= F.greatest(F.lit(1.0), F.col("exact_keys") * DISTINCT_ERROR)).alias("keys_within"),
        rank_near.alias("median_within"),
    )


_NOW, _LIMIT = "1998-08-02 00:00:00", 120


def _runs(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("s"), "o_custkey").alias("source_code"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "O").alias("ok"),
    )


_SQL_RUNS = """
    r AS (SELECT 's' || o_custkey AS source_code, o_orderdate::TIMESTAMP AS started_at, o_orderkey AS id,
            o_orderstatus = 'O' AS ok FROM orders)
"""


@query(
    "silent_sources",
    f"""
    WITH {_SQL_RUNS}, s AS (SELECT 's' || c_custkey AS source_code FROM customer),
    k AS (SELECT source_code, max(started_at) AS last_success FROM r WHERE ok GROUP BY source_code),
    n AS (SELECT r.source_code, count(*) AS n_streak FROM r LEFT JOIN k USING (source_code)
          WHERE NOT ok AND (last_success IS NULL OR started_at > last_success) GROUP BY r.source_code)
    SELECT source_code, strftime(last_success, '%Y-%m-%d') AS last_success, coalesce(n_streak, 0) AS n_streak, reason
    FROM (SELECT *, CASE WHEN last_success IS NULL THEN 'never'
        WHEN last_success < TIMESTAMP '{_NOW}' - INTERVAL {_LIMIT} DAY THEN 'silent'
        WHEN coalesce(n_streak, 0) >= 3 THEN 'failing' END AS reason
      FROM s LEFT JOIN k USING (source_code) LEFT JOIN n USING (source_code))
    WHERE reason IS NOT NULL
    """,
)
def silent(spark, sf):
    """Sources (customers) without a success (an open order) for long, ever, or in their last runs."""
    sources = table(spark, sf, "customer").select(F.concat(F.lit("s"), "c_custkey").alias("source_code"))
    found = silent_sources(sources, _runs(spark, sf), _NOW, _LIMIT)
    return found.withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd"))


@query(
    "failure_streaks",
    f"""
    WITH {_SQL_RUNS}, n AS (
      SELECT *, count(*) FILTER (ok) OVER (PARTITION BY source_code ORDER BY started_at, id) AS streak FROM r)
    SELECT source_code, strftime(min(started_at), '%Y-%m-%d') AS since,
      strftime(max(started_at), '%Y-%m-%d') AS until, count(*) AS n_runs
    FROM n WHERE NOT ok GROUP BY source_code, streak HAVING count(*) >= 3
    """,
)
def streaks(spark, sf):
    """Three runs of a source, or more, in a row without result."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return failure_streaks(_runs(spark, sf), 3).select("source_code", day("since"), day("until"), "n_runs")
