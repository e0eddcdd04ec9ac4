"""Run log, lookups, deletes, checks and schema changes."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidings.operators import evolve, integrity, lookup
from tidings.operators.delete import delete_from_store, delete_range
from tidings.operators.runs import check_limit, recent_runs, started_run, update_runs
from tidings.operators.sources import registry, require_known, seed_missing, split_unknown
from tidings.plans.sites import SITES
from tidings.schema import NOTICES, RUNS, conform
from tidings.sources.store import NoticeStore

DAY = datetime.datetime(2024, 1, 1)


def at(days):
    return DAY + datetime.timedelta(days=days)


def run(i, source, task, day, status="running"):
    return (i, source, task, at(day), None, status, 0, None)


def test_recent_runs(spark):
    runs = spark.createDataFrame(
        [run(1, 1, "a", 1), run(2, 2, "b", 3), run(3, 1, "c", 3), run(4, 9, "d", 9)], RUNS
    )
    sources = spark.createDataFrame([(1, "ai"), (2, "glc")], "id long, external_id string")
    got = recent_runs(runs, sources, 2).collect()
    assert [(r.source_code, r.started_at) for r in got] == [
        ("glc", "2024-01-04T00:00:00+00:00"), ("ai", "2024-01-04T00:00:00+00:00"),
    ]
    assert got[0].finished_at is None
    for bad in (0, 201):
        with pytest.raises(ValueError):
            check_limit(bad)


def test_run_updates(spark):
    runs = spark.createDataFrame([run(1, 1, "a", 1), run(2, 1, "a", 2), run(3, 1, "b", 1)], RUNS)
    updates = spark.createDataFrame(
        [("a", at(5), "failed", None, "e" * 3000), ("zz", None, "x", 1, None)],
        "task_id string, finished_at timestamp, status string, notices_upserted int, error_message string",
    )
    got = {r.id: r for r in update_runs(runs, updates).collect()}
    assert len(got) == 3
    assert (got[1].status, got[3].status) == ("running", "running")
    assert (got[2].status, got[2].notices_upserted, got[2].finished_at) == ("failed", 0, at(5))
    assert len(got[2].error_message) == 2000


def test_started_run(spark):
    row = started_run(spark, 3, "t", DAY).first()
    assert (row.source_id, row.task_id, row.status, row.notices_upserted) == (3, "t", "running", 0)
    assert row.started_at == DAY and row.finished_at is None


def test_registry(spark):
    known = registry(spark, SITES, {"glc": "https://school.example/list"})
    assert known.count() == 7
    assert known.filter("external_id = 'glc'").first().list_url == "https://school.example/list"
    assert known.filter("list_url IS NULL").count() == 6
    require_known("glc", SITES)
    with pytest.raises(ValueError):
        require_known("law", SITES)
    rows = spark.createDataFrame([("glc",), ("law",), (None,)], "source_code string")
    good, unknown = split_unknown(rows, known)
    assert [r[0] for r in good.collect()] == ["glc"]
    assert {r[0] for r in unknown.collect()} == {"law", None}
    partly = known.filter("external_id = 'ai'").withColumn("name", F.lit("mine"))
    seeded = {r.external_id: r.name for r in seed_missing(partly, known, "external_id").collect()}
    assert len(seeded) == 7 and seeded["ai"] == "mine"


def test_lookups(spark):
    rows = spark.createDataFrame(
        [(1, "a", at(1), "x" * 60), (2, "b", at(2), None), (3, "a", at(2), "t")],
        "id int, code string, ts timestamp, title string",
    )
    assert [r.id for r in lookup.by_columns(rows, code="a", id=3).collect()] == [3]
    wanted = spark.createDataFrame([("b",), ("b",), ("z",)], "code string")
    assert [r.id for r in lookup.by_keys(rows, wanted, ["code"]).collect()] == [2]
    got = [(r.id, r.preview) for r in lookup.newest(rows, "ts", "id", "title", 3).collect()]
    assert got == [(2, ""), (3, "t"), (1, "x" * 50)]


def test_enrichment_gate(spark):
    notices = spark.createDataFrame(
        [(1, None), (2, "{}"), (3, '{"a":1}'), (4, " {} "), (5, None)],
        "id int, ai_extracted_json string",
    )
    feed = spark.createDataFrame([(i,) for i in (1, 1, 2, 3, 4, 99)], "id int")
    done = spark.createDataFrame([(4,)], "id int")

    def ids(frame):
        return sorted(r.id for r in frame.collect())

    assert ids(lookup.enrich_pending(feed, notices)) == [1, 2, 4]
    assert ids(lookup.enrich_pending(feed, notices, done)) == [1, 2]
    assert ids(lookup.enrich_pending(feed, notices, reenrich_changed=True)) == [1, 2, 3, 4]


def test_delete_with_strict_bounds_and_references(spark):
    rows = spark.createDataFrame(
        [(i, "ai" if i != 5 else "glc", at(i)) for i in range(1, 6)] + [(6, "ai", None)],
        "id int, source_code string, created_at timestamp",
    )
    refs = spark.createDataFrame([(3,), (5,)], "id int")
    done = delete_range(
        rows, "source_code", "ai", "created_at", before="2024-01-05", after="2024-01-02",
        references=refs,
    )
    assert [r.id for r in done.deleted.collect()] == [2] or sorted(
        r.id for r in done.deleted.collect()
    ) == [2]
    assert [r.id for r in done.blocked.collect()] == [3]
    assert sorted(r.id for r in done.kept.collect()) == [1, 3, 4, 5, 6]
    everything = delete_range(rows, "source_code", "ai", "created_at")
    assert sorted(r.id for r in everything.kept.collect()) == [5]
    assert everything.blocked.count() == 0


def test_checks(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1), (1, "a", 2), (2, None, 3), (2, "b" * 5, None)], "k int, t string, p int"
    )
    parents = spark.createDataFrame([(1,)], "id int")
    found = integrity.all_checks(
        integrity.check_unique(rows, "x", ["k"]),
        integrity.check_foreign_key(rows, "x", "p", parents, "id"),
        integrity.check_rules(
            rows, "x", integrity.not_null("t") | integrity.max_length("t", 4) | integrity.not_null("k")
        ),
    )
    assert sorted(tuple(r) for r in found.collect()) == [
        ("x", "foreign_key", "2", 1), ("x", "foreign_key", "3", 1), ("x", "max_length(t)", "", 1),
        ("x", "not_null(t)", "", 1), ("x", "unique", "1", 2), ("x", "unique", "2", 2),
    ]
    good, broken = integrity.split_by_rules(rows, integrity.not_null("t") | integrity.max_length("t", 4))
    assert good.count() == 2
    assert sorted(r.broken_rules[0] for r in broken.collect()) == ["max_length(t)", "not_null(t)"]


def test_quality_gate(spark):
    rows = spark.createDataFrame(
        [("h", at(1)), ("h", None), ("i", None), ("j", at(1))],
        "content_hash string, published_at timestamp",
    )
    assert tuple(integrity.quality_gate(rows).first()) == (4, 2, 1, 2)


def test_schema_changes(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "id int, t string")
    wider = evolve.add_columns(rows, {"flag": ("boolean", False), "t": ("string", "no")})
    assert [tuple(r) for r in wider.orderBy("id").collect()] == [(1, "x", False), (2, None, False)]
    assert evolve.drop_columns(wider, "t", "flag").columns == ["id"]
    assert evolve.require_columns(rows.filter("id = 1"), "t").count() == 1
    with pytest.raises(Exception, match="required column t"):
        evolve.require_columns(rows, "t").collect()


def test_a_version_without_records_is_logged(spark, tmp_path):
    store = NoticeStore(spark, str(tmp_path / "s")).create()
    assert store.write(spark.createDataFrame([], NOTICES), []) == 1
    assert store.next_version() == 2 and store.read().count() == 0


def test_delete_from_store(spark, tmp_path):
    store = NoticeStore(spark, str(tmp_path / "s")).create()
    rows = spark.createDataFrame(
        [(1, "glc", "2024-01-01"), (2, "glc", "2024-03-01"), (3, "glc", None), (4, "ai", "2024-03-01")],
        "id long, source_code string, created_at string",
    )
    store.write(conform(rows, NOTICES), ["glc", "ai"])
    with pytest.raises(ValueError):
        delete_from_store(store, "law", SITES)
    used = spark.createDataFrame([(2,)], "id long")
    done = delete_from_store(store, "glc", SITES, after="2023-12-31", references=used)
    assert (done.version, done.deleted, done.blocked) == (2, 1, 1)
    assert {r.id for r in store.read().collect()} == {2, 3, 4}
