"""Listings by cursor, archive, month view, keyword tags."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from tidings.operators.archive import archive, compact, month_view, read_archive
from tidings.operators.listing import page, sort_key, write_listing
from tidings.operators.tags import tags_of


def test_walking_all_pages_gives_each_row_once(spark, tmp_path):
    draw = random.Random(1)
    rows = [(k, draw.choice([None, 1, 2, 3, 50])) for k in range(230)]
    frame = spark.createDataFrame(rows, "id long, at long").repartition(4)
    path = str(tmp_path / "listing")
    write_listing(frame, path, sort_key((F.col("at"), True), (F.col("id"), False)), file_rows=30)
    files = len(spark.read.parquet(f"{path}/rows").inputFiles())
    seen, cursor, most = [], None, 0
    while True:
        found = page(spark, path, 25, cursor)
        most = max(most, len(found.inputFiles()) if seen and len(seen) < 200 else 0)
        part = found.collect()
        if not part:
            break
        seen += [(r.id, r.at) for r in part]
        cursor = part[-1].cursor
    low = -(1 << 62)
    assert seen == sorted(rows, key=lambda r: (-(low if r[1] is None else r[1]), r[0]))
    assert files >= 8 and most <= 3
    assert page(spark, path, 5, cursor).count() == 0


ARCHIVED = "id long, source_code string, at timestamp"


def test_archive_again_and_compact(spark, tmp_path):
    path = str(tmp_path / "archive")
    day = lambda m, d: datetime.datetime(2024, m, d)
    rows = [(k, "ab"[k % 2], day(k % 3 + 1, k % 28 + 1)) for k in range(60)] + [(99, "a", None)]
    frame = spark.createDataFrame(rows, ARCHIVED).repartition(5)
    archive(frame, path, "at")
    archive(frame.filter("month(at) = 2"), path, "at")
    everything = lambda: sorted((r.id, r.source_code, r.at) for r in read_archive(spark, path, ARCHIVED).collect())
    assert [r[0] for r in everything()] == sorted(r[0] for r in rows)
    february = read_archive(spark, path, ARCHIVED, ["2024-02"], ["a"])
    assert {r.id for r in february.collect()} == {k for k in range(60) if k % 3 == 1 and k % 2 == 0}
    plan = february._jdf.queryExecution().toString()
    assert "month" in plan.split("PartitionFilters: [")[1].split("]")[0] and "PushedFilters: []" in plan
    assert read_archive(spark, path, ARCHIVED, ["none"]).first().id == 99
    frame.filter("month(at) = 2").withColumn("month", F.lit("2024-02")).repartition(6).write.mode("append").partitionBy(
        "source_code", "month"
    ).parquet(path)
    compact(spark, path, ARCHIVED, "at", ["2024-02"])
    assert len(everything()) == 81


def test_month_view(spark):
    at = lambda *a: datetime.datetime(2024, *a)
    spans = [
        (1, at(1, 31), at(2, 1)), (2, at(1, 31), at(2, 1, 0, 1)), (3, at(2, 1), None), (4, at(1, 5), at(5, 5)),
        (5, at(3, 9), at(3, 1)), (6, at(4, 1), at(4, 1)), (7, None, at(2, 2)), (8, at(3, 1), at(4, 1)),
    ]
    frame = spark.createDataFrame(spans, "id long, start_at timestamp, end_at timestamp")
    got = sorted((r.id, r.month.month) for r in month_view(frame, "2024-02-01", "2024-05-01").collect())
    assert got == [(2, 2), (3, 2), (4, 2), (4, 3), (4, 4), (5, 3), (6, 4), (8, 3)]


@pytest.mark.parametrize("group", [10, 1 << 20])
def test_tags_equal_pattern_by_pattern(spark, group):
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abcé ") for _ in range(n))
    patterns = [(word(draw.randint(1, 4)), draw.choice("xyz")) for _ in range(40)] + [("", "x"), (None, "y"), ("a", None)]
    texts = [(k, word(draw.randint(0, 30))) for k in range(60)] + [(100, None), (100, "abc"), (101, "aaaa")]
    got = tags_of(
        spark.createDataFrame(texts, "id long, text string"),
        spark.createDataFrame(patterns, "pattern string, tag string"),
        group,
    ).collect()
    want = {(i, tag) for i, t in texts for p, tag in patterns if t and p and tag and p in t}
    assert len(got) == len(want) and {(r.id, r.tag) for r in got} == want
    none = spark.createDataFrame([], "pattern string, tag string")
    assert tags_of(spark.createDataFrame(texts, "id long, text string"), none).count() == 0
