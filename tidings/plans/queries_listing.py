"""Queries of listings by cursor, the archive, the month view, keyword tags, the registry and run states."""

from __future__ import annotations

import datetime
import itertools
import json
import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidings.operators.archive import archive, month_view, read_archive
from tidings.operators.listing import page, sort_key, write_listing
from tidings.operators.search import terms_of
from tidings.operators.sources import registry
from tidings.operators.tags import tags_of
from tidings.plans import boards
from tidings.plans.catalog import query, table
from tidings.plans.crawl import links_of, posts_of, read_runs, run_logged
from tidings.plans.queries_pages import SQL_POSTS
from tidings.plans.sites import SITES
from tidings.schema import NOTICES, conform
from tidings.session import shared_folder, staged
from tidings.sources.store import NoticeStore

_PAGE = 50
#: Date and key of the last row of the page before.
_LAST = ("1995-06-17", 1000)


def _folder(spark, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


@query(
    "paged_listing",
    f"""
    SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
    WHERE o_orderdate < DATE '{_LAST[0]}' OR (o_orderdate = DATE '{_LAST[0]}' AND o_orderkey > {_LAST[1]})
    ORDER BY o_orderdate DESC, o_orderkey LIMIT {_PAGE}
    """,
)
def paged_listing(spark, sf):
    """A page deep in the list of orders, newest first, from the files that hold it."""
    path = _folder(spark, "listing")
    day = F.unix_date(F.col("o_orderdate").cast("date"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    write_listing(orders, path, sort_key((day, True), (F.col("o_orderkey"), False)), file_rows=2000)
    at = (datetime.date.fromisoformat(_LAST[0]) - datetime.date(1970, 1, 1)).days
    rows = page(spark, path, _PAGE, json.dumps([-at, _LAST[1]]))
    return rows.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query(
    "archive_month",
    """
    SELECT o_orderkey AS id, o_orderpriority AS source_code FROM orders
    WHERE strftime(o_orderdate, '%Y-%m') IN ('1994-02', '1996-11')
    """,
)
def archive_month(spark, sf):
    """Two months of an archive of all orders, into which one year has been written twice."""
    path = _folder(spark, "archive")
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("source_code"),
        F.col("o_orderdate").cast("timestamp").alias("at"),
    )
    archive(orders, path, "at")
    archive(orders.filter(F.year("at") == 1994), path, "at")
    found = read_archive(spark, path, "id bigint, source_code string, at timestamp", ["1994-02", "1996-11"])
    return found.select("id", "source_code")


@query(
    "month_view",
    """
    WITH s AS (
      SELECT o_orderkey AS id, 'date' AS kind, o_orderdate::TIMESTAMP AS a,
        o_orderdate::TIMESTAMP + to_days(CAST(o_orderkey % 75 AS INT)) AS b FROM orders
      UNION ALL SELECT event_id, 'saved', ts, NULL FROM events),
    m AS (SELECT unnest(generate_series(DATE '1995-01-01', DATE '1997-12-01', INTERVAL 1 MONTH))::DATE AS month
      UNION ALL SELECT DATE '2024-01-01')
    SELECT kind, id, strftime(month, '%Y-%m') AS month FROM s, m
    WHERE (a >= month AND a < month + INTERVAL 1 MONTH)
       OR (b > a AND a < month + INTERVAL 1 MONTH AND b > month)
    """,
)
def months(spark, sf):
    """Spans that orders open, in three years, and saved events, each once per month it touches."""
    start = F.col("o_orderdate").cast("timestamp")
    spans = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit("date").alias("kind"),
        start.alias("start_at"),
        (start + F.make_dt_interval((F.col("o_orderkey") % 75).cast("int"))).alias("end_at"),
    )
    saved = table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.lit("saved").alias("kind"),
        F.col("ts").alias("start_at"),
        F.lit(None).cast("timestamp").alias("end_at"),
    )
    both = month_view(spans, "1995-01-01", "1998-01-01").unionByName(month_view(saved, "2024-01-01", "2024-02-01"))
    return both.select("kind", "id", F.date_format("month", "yyyy-MM").alias("month"))


@query(
    "keyword_tags",
    r"""
    WITH p AS (
      SELECT DISTINCT w AS pattern, 'length ' || length(w) AS tag
      FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark) WHERE length(w) >= 9)
    SELECT DISTINCT doc_id AS id, tag FROM documents, p WHERE contains(text, pattern)
    """,
)
def keyword_tags(spark, sf):
    """Documents that hold a long word of the benchmark items, tagged by its length."""
    words = table(spark, sf, "benchmark").select(F.explode(terms_of(F.col("text"))).alias("pattern"))
    patterns = words.filter(F.length("pattern") >= 9).withColumn("tag", F.concat(F.lit("length "), F.length("pattern")))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return tags_of(texts, patterns)


_CODES = ", ".join(f"'{c}'" for c in boards.CODES)


@query(
    "registry_rows",
    f"""
    WITH c AS (SELECT unnest([{_CODES}]) AS source_code, unnest(range(7)) AS k)
    SELECT source_code AS external_id,
      CASE WHEN source_code <> 'ai' THEN 'https://' || source_code || '.example.org/board/list' END AS list_url,
      (SELECT count(*) FROM documents WHERE doc_id % 7 = k) AS n_pages
    FROM c
    """,
)
def registry_rows(spark, sf):
    """The registry with its list addresses (one source has none), and the captured pages of each list."""
    addresses = {c: f"https://{c}.example.org/board/list" for c in boards.CODES if c != "ai"}
    pages = boards.list_pages(table(spark, sf, "documents"))
    counts = pages.groupBy("source_code").agg(F.count("*").alias("n_pages"))
    sources = registry(spark, SITES, addresses)
    joined = sources.join(counts, F.col("source_code") == F.col("external_id"), "left")
    return joined.select("external_id", "list_url", F.coalesce("n_pages", F.lit(0)).alias("n_pages"))


@query(
    "run_states",
    f"""
    WITH c AS (SELECT unnest([{_CODES}]) AS code, unnest(range(7)) AS k)
    SELECT 'crawl ' || code AS task_id, CASE WHEN code = 'ai' THEN 'failed' ELSE 'success' END AS status,
      CASE WHEN code = 'ai' THEN 0 ELSE (SELECT count(*) FROM documents WHERE doc_id % 7 = k)::INT END AS notices_upserted,
      CASE WHEN code = 'ai' THEN 'no list of ai' END AS error_message, true AS ended
    FROM c
    """,
)
def run_states(spark, sf):
    """Runs that store each source's documents, one of which fails, by way of the run log."""
    store = NoticeStore(spark, _folder(spark, "store")).create()
    log = _folder(spark, "log")
    documents = table(spark, sf, "documents")
    ticks = itertools.count()
    clock = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=next(ticks))
    notices = documents.select(
        boards.source_of(F.col("doc_id")).alias("source_code"), F.col("doc_id").cast("string").alias("external_id")
    )

    def job(code):
        if code == "ai":
            raise ValueError("no list of ai")
        store.write(conform(notices.filter(F.col("source_code") == code), NOTICES), [code])
        return SimpleNamespace(upserted=store.read([code]).count())

    for number, code in enumerate(boards.CODES):
        try:
            run_logged(log, spark, number, f"crawl {code}", clock, lambda code=code: job(code))
        except ValueError:
            pass  # it is in the log
    ended = (F.col("finished_at") > F.col("started_at")).alias("ended")
    return read_runs(spark, log).select("task_id", "status", "notices_upserted", "error_message", ended)


@query(
    "page_rejects",
    f"""
    {SQL_POSTS}
    SELECT source_code, CASE WHEN post % 17 = 3 THEN 'no_content' ELSE 'page_too_large' END AS reason,
      count(DISTINCT url) AS n
    FROM posts
    WHERE post % 13 <> 5 AND (post % 17 = 3 OR (source_code = 'glc' AND post % 499 = 5)) GROUP BY ALL
    """,
)
def page_rejects(spark, sf):
    """Captured pages without content, and those over the one source's size limit."""
    documents = table(spark, sf, "documents")
    post = F.col("page_id")
    big = F.concat("html", F.repeat(F.lit("x"), max(s.max_page_bytes or 0 for s in SITES)))
    large = (F.col("source_code") == "glc") & (post % 499 == 5)
    pages = boards.post_pages(documents).withColumn(
        "html", F.when(post % 17 == 3, None).when(large, big).otherwise(F.col("html"))
    )
    links = staged(links_of(boards.list_pages(documents), SITES))
    _, missing = posts_of(links, pages, SITES)
    found = missing.filter("reason IN ('no_content', 'page_too_large')")
    return found.groupBy("source_code", "reason").agg(F.count("*").alias("n"))
