"""Page snapshots: scan, decoding of raw bytes, size guard, latest capture per address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.decode import KOREAN_CHARSET, decode_cp949, decode_utf8
from tidings.functions.dom import parse_html
from tidings.operators.payload import MAX_HTML_BYTES
from tidings.operators.sources import per_source
from tidings.schema import PAGES
from tidings.session import sent, staged


def read_pages(spark: SparkSession, path: str, schema: str = PAGES) -> DataFrame:
    """Captured pages; the schema is given, so nothing is inferred."""
    return spark.read.schema(schema).parquet(path)


def decoded(pages: DataFrame, sites, raw: str = "content", column: str = "html") -> DataFrame:
    """Replace raw bytes by text, in the charset of each page's source."""
    korean = [s.code for s in sites if s.charset == KOREAN_CHARSET]
    bytes_ = F.col(raw)
    text = decode_utf8(bytes_)
    if korean:
        is_korean = F.col("source_code").isin(*korean)
        # The Python decoder only ever sees the pages that need it; others pass as null.
        text = F.coalesce(decode_cp949(F.when(is_korean, bytes_)), F.when(~is_korean, text))
    return pages.withColumn(column, text).drop(raw)


def too_large(html: Column, max_bytes: int | Column = MAX_HTML_BYTES) -> Column:
    return F.octet_length(html) > max_bytes


def download_limit(sites) -> Column:
    """The size limit of a page by its source; null where a source has none."""
    limits = {s.code: F.lit(s.max_page_bytes) for s in sites if s.max_page_bytes is not None}
    none = F.lit(None).cast("int")
    return per_source(F.col("source_code"), limits, none)


def split_by_content(pages: DataFrame, carried=()):
    """Pages captured with content, and rejects for those without, with ``carried`` columns."""
    without = pages.filter(F.col("html").isNull()).select(
        "source_code",
        "url",
        F.lit("no_content").alias("reason"),
        F.lit(None).cast("string").alias("detail"),
        *carried,
    )
    return pages.filter(F.col("html").isNotNull()), without


def split_by_size(pages: DataFrame, max_bytes: int | Column = MAX_HTML_BYTES, carried=()):
    """Pages within the size limit, and rejects for the others (``carried`` columns, without their HTML)."""
    big = F.coalesce(too_large(F.col("html"), max_bytes), F.lit(False))
    rejected = pages.filter(big).select(
        "source_code",
        "url",
        F.lit("page_too_large").alias("reason"),
        F.octet_length("html").cast("string").alias("detail"),
        *carried,
    )
    return pages.filter(~big), rejected


def split_readable(pages: DataFrame, max_bytes: int | Column = MAX_HTML_BYTES, carried=()):
    """``split_by_size`` and then ``split_by_content``; the rejects of both come from one reading of the pages."""
    is_empty, is_big = F.col("html").isNull(), F.coalesce(too_large(F.col("html"), max_bytes), F.lit(False))
    rejected = pages.filter(is_empty | is_big).select(
        "source_code",
        "url",
        F.when(is_empty, "no_content").otherwise("page_too_large").alias("reason"),
        F.octet_length("html").cast("string").alias("detail"),
        *carried,
    )
    return pages.filter(~is_empty & ~is_big), rejected


def dated(pages: DataFrame) -> DataFrame:
    """Pages with ``_at``, the time by which captures are compared."""
    return pages.withColumn("_at", F.coalesce("fetched_at", F.lit("0001-01-01").cast("timestamp")))


def latest_captures(pages: DataFrame) -> DataFrame:
    """The newest capture of every address.

    Older captures are found on narrow columns. As long as few addresses have them, these go to every task
    and no page is shuffled.
    """
    rows, keys = dated(pages), ["source_code", "url"]
    newest = rows.select(*keys, F.struct("_at", "page_id").alias("capture")).groupBy(*keys)
    repeated = staged(
        newest.agg(F.min("capture").alias("_oldest"), F.max("capture").alias("_newest"))
        .filter("_oldest < _newest")
        .drop("_oldest")
    )
    known = rows.dropna(subset=[*keys, "page_id"]).alias("p")
    one = [F.col(f"p.{k}") == F.col(f"n.{k}") for k in keys]
    older = F.struct("p._at", "p.page_id") < F.col("n._newest")
    return known.join(sent(repeated).alias("n"), [*one, older], "left_anti").drop("_at")


def trees(pages: DataFrame, max_bytes: int | None = None, carried=()) -> DataFrame:
    """Pages with content, their element tree and ``carried`` columns; given a limit, pages over it are not parsed."""
    within = pages.filter(F.col("html").isNotNull())
    if max_bytes is not None:
        within = within.filter(~too_large(F.col("html"), max_bytes))
    return within.select("source_code", "page_id", "url", *carried, parse_html(F.col("html")).alias("dom"))
