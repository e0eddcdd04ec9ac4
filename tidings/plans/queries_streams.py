"""Streaming queries: incremental ingest of files, and the feed that may deliver twice."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidings.functions.text import content_hash, visible_text
from tidings.functions.urls import external_id
from tidings.operators.dedup import first_seen
from tidings.operators.upsert import changed, classify, merge
from tidings.plans import boards
from tidings.plans.catalog import query, sql_content_hash, sql_external_id, table
from tidings.plans.queries_pages import SQL_CRAWLED
from tidings.plans.sites import SITES
from tidings.schema import PAGES, conform
from tidings.session import PACKED, shared_folder
from tidings.sources.parts import PartTable
from tidings.sources.store import NoticeStore
from tidings.streaming.ingest import (
    consume_feed,
    crawl_handler,
    keyed_upsert_handler,
    page_stream,
    run_available,
)

PAGES_SCHEMA = "page_id bigint, url string, html string"
TABLE_SCHEMA = (
    "external_id string, url string, raw_html string, content_hash string, updated_at timestamp"
)


def _records(pages):
    """First page per key, as records."""
    keyed = pages.select(
        external_id(F.col("url")).alias("external_id"),
        "url",
        F.col("html").alias("raw_html"),
        content_hash(F.lit("page"), F.col("html")).alias("content_hash"),
        "page_id",
    )
    return first_seen(keyed, ["external_id"], [F.asc("page_id")])


def _merged(stored, incoming):
    return merge(
        stored,
        incoming,
        "2024-06-01 00:00:00",
        keys=("external_id",),
        updated=("url", "raw_html", "content_hash"),
        kept=(),
    )


def _drop(pages, list_pages, folder: str) -> None:
    """Add pages to the folder that a stream reads, lists marked as such."""
    marked = ((list_pages, True), (pages, False))
    one, other = (conform(p.withColumn("is_list", F.lit(is_list)), DROPPED) for p, is_list in marked)
    one.unionByName(other).write.options(**PACKED).mode("append").parquet(folder)


DROPPED = f"{PAGES}, is_list boolean"


@query("stream_crawl", SQL_CRAWLED)
def stream_crawl(spark, sf):
    """Lists before their posts and posts before their lists, in two drops, give one crawl's notices."""
    folder = _stream_folder(spark)
    store = NoticeStore(spark, f"{folder}/store").create()
    handler = crawl_handler(store, SITES, F.col("is_list"), lambda: "2024-06-01 00:00:00")
    documents = table(spark, sf, "documents")
    even, odd = (documents.filter(F.col("doc_id") % 2 == k) for k in (0, 1))
    for first, second in ((even, odd), (odd, even)):
        _drop(boards.post_pages(second), boards.list_pages(first), f"{folder}/pages")
        stream = page_stream(spark, f"{folder}/pages", DROPPED)
        run_available(stream, f"{folder}/checkpoint", handler).awaitTermination()
    published = F.date_format("published_at", "yyyy-MM-dd").alias("published_on")
    return store.read().select("source_code", "external_id", "title", "url", "content_hash", published)


def _stream_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


_SQL_FIRST = f"""
    SELECT external_id, url, content_hash FROM (
      SELECT page_id, {sql_external_id('url')} AS external_id, url,
             {sql_content_hash("'page'", 'html')} AS content_hash
      FROM pages)
    QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY page_id) = 1
"""


@query("stream_upsert", _SQL_FIRST)
def stream_upsert(spark, sf):
    """Two file drops of the same pages, one micro-batch each: the second changes nothing."""
    folder = _stream_folder(spark)
    pages = table(spark, sf, "pages")
    bucket = {"bucket": F.pmod(F.xxhash64("external_id"), F.lit(8)).cast("int")}
    stored = PartTable(spark, f"{folder}/table", TABLE_SCHEMA, bucket)
    handler = keyed_upsert_handler(stored, _records, _merged)
    for _ in range(2):
        pages.write.mode("append").parquet(f"{folder}/pages")
        stream = page_stream(spark, f"{folder}/pages", PAGES_SCHEMA)
        run_available(stream, f"{folder}/checkpoint", handler).awaitTermination()
    return stored.read_parts(stored.state()).select("external_id", "url", "content_hash")


@query(
    "stream_feed",
    f"""
    WITH t AS ({_SQL_FIRST})
    SELECT external_id AS id, content_hash FROM t WHERE content_hash NOT LIKE '0%'
    """,
)
def stream_feed(spark, sf):
    """A change feed written twice by at-least-once batches, consumed once per content.

    Contents whose hash starts with 0 were handled before.
    """
    folder = _stream_folder(spark)
    table(spark, sf, "pages").write.mode("append").parquet(f"{folder}/pages")

    def deliver(rows, batch_id):
        records = _records(rows)
        keys = changed(
            classify(rows.sparkSession.createDataFrame([], TABLE_SCHEMA), records, ("external_id",))
        )
        feed = keys.join(records.select("external_id", "content_hash"), "external_id")
        for delivery in ("first", "again"):
            feed.select(F.col("external_id").alias("id"), "content_hash").write.mode(
                "overwrite"
            ).parquet(f"{folder}/feed/batch={batch_id}/delivery={delivery}")

    stream = page_stream(spark, f"{folder}/pages", PAGES_SCHEMA)
    run_available(stream, f"{folder}/checkpoint", deliver).awaitTermination()
    feed = spark.read.schema("id string, content_hash string").parquet(f"{folder}/feed/*/*")
    notices = _records(table(spark, sf, "pages")).select(
        F.col("external_id").alias("id"), "content_hash", F.lit(None).cast("string").alias("ai_extracted_json")
    )
    done = feed.filter(F.col("content_hash").startswith("0"))
    return consume_feed(feed, notices, done).select("id", "content_hash")
