"""Physical plans: what must be pruned, pushed down, or done before a shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tests.conftest import SF_SMALL
from tidings.functions import dates, text, urls
from tidings.operators.upsert import upsert_notices
from tidings.plans import boards, queries_pages
from tidings.plans.catalog import QUERIES, table
from tidings.plans.crawl import links_of, posts_of
from tidings.plans.queries_tables import _batch, _stored
from tidings.plans.sites import SITES
from tidings.session import staged


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


def run(spark, name):
    assert name in queries()
    return QUERIES[name](spark, SF_SMALL)


def test_point_lookup_reaches_the_scan(spark):
    plan = plan_of(run(spark, "point_lookup"))
    assert "EqualTo(o_orderkey,5)" in plan


def test_first_seen_drops_rows_before_the_shuffle(spark):
    plan = plan_of(run(spark, "first_seen"))
    assert plan.count("WindowGroupLimit") >= 2
    assert "Partial" in plan


def test_top_k_is_no_full_sort(spark):
    for name in ("recent_runs", "latest_n"):
        assert "TakeOrderedAndProject" in plan_of(run(spark, name))


def test_checks_read_only_their_columns(spark):
    plan = plan_of(run(spark, "check_unique"))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_linenumber:int>", plan)


def test_expressions_need_no_python_and_no_shuffle(spark):
    pages = table(spark, SF_SMALL, "pages")
    url, html = F.col("url"), F.col("html")
    columns = [
        urls.external_id(url), urls.url_normalized(url), urls.resolve_url(url, html),
        text.visible_text(html), text.content_hash(url, html), text.clean_html(html),
        dates.published_at(url), dates.date_month_name(url), dates.date_from_parts(url),
    ]
    plan = plan_of(pages.select(*columns))
    assert "Python" not in plan and "Exchange" not in plan


def test_pages_are_parsed_where_they_are_read(spark):
    assert "Exchange" not in plan_of(run(spark, "page_detail"))


def test_parser_runs_once_and_after_the_page_filter(spark):
    documents = table(spark, SF_SMALL, "documents")
    links = links_of(boards.list_pages(documents), SITES)
    assert "ArrowEvalPython" in plan_of(links)
    narrow = spark.createDataFrame([], links.schema)
    posts, _ = posts_of(narrow, boards.post_pages(documents), SITES)
    filtered = posts.filter(F.col("title") != "")
    tree = plan_of(filtered).split("\n\n\n")[0]
    assert len(re.findall(r"ArrowEvalPython", tree)) <= 1


def test_upsert_has_no_full_outer_join_and_no_cross_join(spark):
    plan = plan_of(upsert_notices(_stored(spark, SF_SMALL), _batch(spark, SF_SMALL), "2024-06-01"))
    assert "FullOuter" not in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan and "LeftAnti" in plan


def test_only_fresh_rows_are_rebalanced(spark):
    stored, batch = _stored(spark, SF_SMALL), _batch(spark, SF_SMALL)
    merged = upsert_notices(stored, batch, "2024-06-01", layout=("source_code",))
    plan = plan_of(merged)
    assert plan.count("REBALANCE_PARTITIONS_BY_COL") == 1


def test_board_templates_are_cut_up_when_planning(spark):
    documents = spark.createDataFrame([(4, "{doc} {title}\n{y}"), (11, None)], "doc_id long, text string")
    for render in (boards.list_pages, boards.detail_pages, boards.post_pages):
        rendered = render(documents).filter("page_id IS NOT NULL")
        plan = spark.range(1).join(rendered)._jdf.queryExecution().optimizedPlan().toString()
        assert "{images}" not in plan and "{mm}" not in plan and "{href}" not in plan
        found = [r.html for r in rendered.collect() if r.html is not None]
        assert found and "{doc} {title}" in found[0]


@pytest.mark.parametrize("name", ["crawl_notices", "crawl_rejects", "crawl_balance"])
def test_crawl_queries_work_out_what_they_ask_for(spark, monkeypatch, name):
    written = []
    monkeypatch.setattr(queries_pages, "staged", lambda rows: written.append(rows.columns) or staged(rows))
    run(spark, name)
    posts = next(columns for columns in written if "html" in columns)
    assert not {"images", "attachment_names"} & set(posts)
    assert ("date_str" in posts) == (name == "crawl_notices")
