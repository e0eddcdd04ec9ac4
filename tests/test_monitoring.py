"""History of notices, activation, sketches, silence."""

import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidings.operators.history import INTERVALS, advance, notice_history, valid_on
from tidings.operators.monitoring import (
    DISTINCT_ERROR,
    change_sketches,
    failure_streaks,
    rolled_up,
    silence_alarms,
    silent_sources,
)
from tidings.operators.usage import activation_rates
from tidings.streaming.ingest import run_available

DAY = datetime.date(2024, 1, 1)


def on(k):
    return DAY + datetime.timedelta(days=k)


def at(k, hour=0):
    return datetime.datetime(2024, 1, 1, hour) + datetime.timedelta(days=k)


def made_up(seed):
    draw = random.Random(seed)
    seen, listings = [], []
    for source in "abc":
        for k in range(14):
            if source == "c" and k > 8 or draw.random() < 0.15:
                continue  # not collected that day
            listings.append((source, on(k), draw.random() < 0.7))
            seen += [(source, str(n), on(k)) for n in range(8) if draw.random() < (0.3, 0.8)[n % 2]]
    return seen, listings


def by_hand(seen, listings):
    """Day by day: what a complete listing lacks is gone."""
    out, open_ = [], {}
    for day in sorted({d for _, d, _ in listings}):
        for source, d, complete in listings:
            if d != day:
                continue
            now = {k for s, k, x in seen if s == source and x == day}
            for k in [k for s, k in open_ if s == source and k not in now] if complete else []:
                out.append((source, k, open_.pop((source, k)), day))
            for k in now:
                open_.setdefault((source, k), day)
    return sorted(out + [(s, k, d, None) for (s, k), d in open_.items()], key=str)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_history_equals_day_by_day(spark):
    seen, listings = made_up(1)
    sightings = spark.createDataFrame(seen * 2, "source_code string, external_id string, day date")
    lists = spark.createDataFrame(listings, "source_code string, day date, complete boolean")
    want = by_hand(seen, listings)
    full = notice_history(sightings, lists)
    assert rows(full) == want and any(r[3] for r in want) and len({r[:2] for r in want}) < len(want)
    there = {(s, k) for s, k, a, b in want if a <= on(6) and (b is None or b > on(6))}
    assert {(r.source_code, r.external_id) for r in full.filter(valid_on(on(6))).collect()} == there
    assert notice_history(sightings.limit(0), lists).count() == 0


def test_history_advances_by_a_day(spark):
    seen, listings = made_up(2)
    sightings = spark.createDataFrame(seen, "source_code string, external_id string, day date")
    lists = spark.createDataFrame(listings, "source_code string, day date, complete boolean")
    before = [r for r in by_hand([s for s in seen if s[2] < on(9)], [x for x in listings if x[1] < on(9)])]
    history = spark.createDataFrame(before, INTERVALS)
    after = by_hand([s for s in seen if s[2] <= on(9)], [x for x in listings if x[1] <= on(9)])
    assert rows(advance(history, sightings, lists, on(9))) == after != before


def test_activation(spark):
    signups = [(1, at(0, 5)), (1, at(3)), (2, at(1)), (3, at(8)), (4, at(2)), (5, None), (None, at(1))]
    actions = [(1, at(0, 1)), (2, at(4)), (2, at(2)), (3, at(15)), (4, at(1)), (4, at(9)), (9, at(1))]
    actions += [(2, at(5))] * 3000 + [(3, None)]
    schema = "user_id long, at timestamp"
    got = activation_rates(spark.createDataFrame(signups, schema), spark.createDataFrame(actions, schema), 7)
    table = {(r.cohort, r.within): (r.users, r.activated) for r in got.collect()}
    assert len(table) == 14 and {u for u, _ in table.values()} == {1, 3}
    whole = Counter()
    for (_, within), (_, n) in table.items():
        whole[within] += n
    assert [whole[k] for k in range(7)] == [1, 2, 2, 2, 2, 2, 2]


def test_sketches_merge(spark):
    changes = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source_code"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") % 40 * 86400).alias("at"),
        (F.col("id") % 7000).alias("key"),
        (F.col("id") % 1000).alias("value"),
    )
    daily = change_sketches(changes, "value")
    got = {r.source_code: r for r in rolled_up(daily, F.lit("all")).collect()}
    for source, want in (("a", 7000), ("b", 7000)):
        assert abs(got[source].n_keys - want) <= DISTINCT_ERROR * want
        assert abs(got[source].q50 - 500) < 30 and abs(got[source].q90 - 900) < 30
    assert got["a"].n + got["b"].n == 60_000
    assert "q50" not in rolled_up(change_sketches(changes), F.lit(1)).columns


RUNS = "source_code string, started_at timestamp, id long, ok boolean"


def test_silence(spark):
    runs = [("a", at(0), 1, True), ("a", at(40), 2, False), ("a", at(41), 3, None), ("a", at(75), 4, False),
            ("b", at(70), 5, True), ("b", at(71), 6, False), ("c", at(1), 7, False), ("d", at(60), 8, True)]
    runs += [("d", at(61 + k), 10 + k, False) for k in range(3)]
    frame = spark.createDataFrame(runs, RUNS)
    streaks = {(r.source_code, r.since, r.until, r.n_runs) for r in failure_streaks(frame, 3).collect()}
    assert streaks == {("a", at(40), at(75), 3), ("d", at(61), at(63), 3)}
    sources = spark.createDataFrame([(s,) for s in "abcde"], "source_code string")
    got = {r.source_code: (r.reason, r.n_streak) for r in silent_sources(sources, frame, at(80), 30).collect()}
    assert got == {"a": ("silent", 3), "c": ("never", 1), "d": ("failing", 3), "e": ("never", 0)}


def test_alarms_of_a_stream(spark, tmp_path):
    """Timers fire once the watermark has passed the limit, once for every silence."""
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    (tmp_path / "in").mkdir()
    alarms = silence_alarms(spark.readStream.schema(RUNS).parquet(inbox), 10, "1 day")

    def keep(found, batch_id):
        found.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drops = [
        [("a", at(0), 1, True), ("b", at(0), 2, True), ("c", at(0), 3, False)],
        [("a", at(9), 4, True), ("b", at(9), 5, False)],
        [("a", at(18), 6, True)],  # b has been silent since day 0
        [("a", at(40), 7, False), ("b", at(40), 8, True)],
        [("z", at(60), 9, True)],
    ]
    seen = []
    for drop in drops:
        spark.createDataFrame(drop, RUNS).coalesce(1).write.mode("append").parquet(inbox)
        run_available(alarms, str(tmp_path / "checkpoint"), keep).awaitTermination()
        found = spark.read.schema("source_code string, last_success timestamp").parquet(f"{out}/*")
        seen.append(sorted((r.source_code, r.last_success) for r in found.collect()))
    assert seen[0] == seen[1] == []
    assert ("b", at(0)) in seen[2]
    assert seen[-1] == [("a", at(18)), ("b", at(0)), ("b", at(40))]


@pytest.fixture(autouse=True)
def utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
