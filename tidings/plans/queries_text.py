"""Queries for the scalar functions: URLs, text, hashes and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.functions import dates, text, urls
from tidings.plans.catalog import (
    query,
    sql_content_hash,
    sql_decode,
    sql_external_id,
    sql_strip,
    sql_visible,
    table,
)
from tidings.plans.sites import NO_TITLE


@query(
    "url_path_only",
    r"SELECT page_id, regexp_replace(url, '[?#].*$', '') AS path_url FROM pages",
)
def url_path_only(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.url_path_only(F.col("url")).alias("path_url")
    )


@query(
    "url_normalized",
    r"""
    WITH parts AS (
      SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base,
             unnest(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&')) AS pair
      FROM pages),
    kept AS (
      SELECT page_id, base, split_part(pair, '=', 1) AS k,
             regexp_extract(pair, '^[^=]*=(.*)$', 1) AS v
      FROM parts),
    joined AS (
      SELECT page_id, any_value(base) AS base,
             string_agg(CASE WHEN v <> '' AND NOT regexp_matches(lower(k),
               '^(utm_|fbclid|gclid|session|sid|from|ref)') THEN k || '=' || v END, '&'
               ORDER BY k) AS q
      FROM kept GROUP BY page_id)
    SELECT page_id, CASE WHEN q IS NULL THEN base ELSE base || '?' || q END AS clean_url
    FROM joined
    """,
)
def url_normalized(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.url_normalized(F.col("url")).alias("clean_url")
    )


@query("external_id", f"SELECT page_id, {sql_external_id('url')} AS external_id FROM pages")
def external_id(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", urls.external_id(F.col("url")).alias("external_id")
    )


_ARTICLE_URL = "concat(url, CASE WHEN url LIKE '%?%' THEN '&' ELSE '?' END, 'no=&idx=', page_id)"


@query(
    "notice_key",
    f"""
    WITH p AS (SELECT page_id, {_ARTICLE_URL} AS url,
                      CASE WHEN page_id % 2 = 0 THEN '' ELSE 'n' || page_id END AS no
               FROM (SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages))
    SELECT page_id, coalesce(nullif(no, ''), {sql_external_id('url')}) AS notice_key FROM p
    """,
)
def notice_key(spark, sf):
    """List number first, else a key parameter; blank parameters do not count."""
    bare = F.regexp_replace("url", "#.*$", "")
    url = F.concat(
        bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("no=&idx="), F.col("page_id")
    )
    number = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.concat(F.lit("n"), "page_id"))
    return table(spark, sf, "pages").select(
        "page_id", urls.notice_key(number, url).alias("notice_key")
    )


@query(
    "image_address",
    r"""
    WITH p AS (
      SELECT p_partkey, 'https://img.example.org/a/b/' || '가 ' || p_name || '*~+.png?v=' || p_partkey AS url
      FROM part)
    SELECT p_partkey,
      'https://img.example.org' || replace(url_encode(substr(regexp_replace(url, '\?.*$', ''), 24)), '%2F', '/')
        || '?v=' || p_partkey AS quoted,
      '가 ' || split_part(url, '가 ', 2)[1:strpos(split_part(url, '가 ', 2), '?') - 1] AS file_name
    FROM p
    """,
)
def image_address(spark, sf):
    """Relative image source resolved, its path percent-encoded, its file name taken."""
    source = F.concat(
        F.lit("../b/./가 "), F.col("p_name"), F.lit("*~+.png?v="), F.col("p_partkey")
    )
    url = urls.resolve_url(F.lit("https://img.example.org/a/c/page.do?x=1#y"), source)
    return table(spark, sf, "part").select(
        "p_partkey",
        urls.quote_path(url).alias("quoted"),
        urls.file_name(url, F.lit("image.jpg")).alias("file_name"),
    )


@query(
    "content_hash",
    f"""
    SELECT doc_id, {sql_content_hash("'doc ' || doc_id", "text")} AS content_hash FROM documents
    """,
)
def content_hash(spark, sf):
    title = F.concat(F.lit("doc "), F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select(
        "doc_id", text.content_hash(title, F.col("text")).alias("content_hash")
    )


@query(
    "page_text",
    f"SELECT page_id, sha256({sql_visible('html')}) AS text_hash, "
    f"length({sql_visible('html')}) AS n_chars FROM pages",
)
def page_text(spark, sf):
    visible = text.visible_text(F.col("html"))
    return (
        table(spark, sf, "pages")
        .select("page_id", visible.alias("visible"))
        .select("page_id", F.sha2("visible", 256).alias("text_hash"), F.length("visible").cast("bigint").alias("n_chars"))
    )


def _sql_element(tag: str) -> str:
    inner = rf"regexp_extract(html, '(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>', 1)"
    return sql_visible(inner, "''")


@query(
    "page_title",
    f"""
    SELECT page_id, coalesce(nullif({_sql_element('h1')}, ''), nullif({_sql_element('title')}, ''),
                             '{NO_TITLE}') AS title
    FROM pages
    """,
)
def page_title(spark, sf):
    html = F.col("html")
    title = text.first_filled(
        text.element_text(html, "h1"), text.element_text(html, "title"), F.lit(NO_TITLE)
    )
    return table(spark, sf, "pages").select("page_id", title.alias("title"))


@query(
    "page_clean",
    r"""
    SELECT page_id, sha256(trim(regexp_replace(html,
      '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'))) AS clean_hash
    FROM pages
    """,
)
def page_clean(spark, sf):
    """Pages without script, style, noscript, iframe and images."""
    return table(spark, sf, "pages").select(
        "page_id", F.sha2(text.clean_html(F.col("html")), 256).alias("clean_hash")
    )


@query(
    "title_preview",
    "SELECT doc_id, coalesce(substr(CASE WHEN doc_id % 10 <> 0 THEN text END, 1, 50), '') AS preview, "
    "substr(text, 1, 2000) AS error_message FROM documents",
)
def title_preview(spark, sf):
    body = F.col("text")
    titled = F.when(F.col("doc_id") % 10 != 0, body)
    return table(spark, sf, "documents").select(
        "doc_id",
        text.preview(titled).alias("preview"),
        text.error_text(body).alias("error_message"),
    )


@query(
    "entities",
    f"""
    SELECT page_id, md5({sql_decode('html')}) AS decoded,
           '가 & é ' || chr(CAST(page_id % 90 + 33 AS INTEGER)) || ' &unknown x' AS rare
    FROM pages
    """,
)
def entities(spark, sf):
    """Character references, the common ones and rare named, decimal and hex ones."""
    rare = F.concat(
        F.lit("&#44032; &amp; &eacute; &#x"), F.hex(F.col("page_id") % 90 + 33), F.lit("; &unknown; x")
    )
    return table(spark, sf, "pages").select(
        "page_id",
        F.md5(text.decode_entities(F.col("html"))).alias("decoded"),
        text.decode_entities(rare).alias("rare"),
    )


@query(
    "published_at",
    """
    WITH o AS (
      SELECT o_orderkey, o_orderdate,
        CASE o_orderkey % 5
          WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
          WHEN 1 THEN year(o_orderdate) || '.' || month(o_orderdate) || '.' || day(o_orderdate)
          WHEN 2 THEN strftime(o_orderdate, '%Y/%m/%d')
          WHEN 3 THEN 'on ' || strftime(o_orderdate, '%Y.%m.%d') || ' 10:00'
          ELSE year(o_orderdate) || '-13-' || day(o_orderdate) END AS text
      FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (0, 1, 3)
             THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00:00' END AS published_at
    FROM o
    """,
)
def published_at(spark, sf):
    """Five renderings of a date: three parse, slashes do not, month 13 does not."""
    d = F.col("o_orderdate")
    style = F.col("o_orderkey") % 5
    rendered = (
        F.when(style == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(d, "yyyy.M.d"))
        .when(style == 2, F.date_format(d, "yyyy/MM/dd"))
        .when(style == 3, F.concat(F.lit("on "), F.date_format(d, "yyyy.MM.dd"), F.lit(" 10:00")))
        .otherwise(F.date_format(d, "yyyy-'13'-d"))
    )
    parsed = dates.published_at(rendered)
    return table(spark, sf, "orders").select(
        "o_orderkey", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("published_at")
    )


@query(
    "date_normalize",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%Y.%m.%d') AS year_first,
           CASE WHEN year(o_orderdate) < 2000 THEN '20' ELSE '' END
             || CASE WHEN year(o_orderdate) < 2000 THEN strftime(o_orderdate, '%y') ELSE strftime(o_orderdate, '%Y') END
             || strftime(o_orderdate, '.%m.%d') AS from_parts,
           strftime(o_orderdate, '%Y.%m.%d') AS from_runs,
           CASE WHEN month(o_orderdate) = 5 THEN strftime(o_orderdate, '%Y.01.%d')
                ELSE strftime(o_orderdate, '%Y.%m.%d') END AS month_name,
           'due soon' AS unchanged
    FROM orders
    """,
)
def date_normalize(spark, sf):
    """The four normalisers on the renderings their sources use."""
    d = F.col("o_orderdate")
    korean = F.date_format(d, "yyyy'년' M'월' d'일'")
    two_digit = F.when(F.year(d) < 2000, F.date_format(d, "yy-MM-dd")).otherwise(
        F.date_format(d, "yyyy/MM/d")
    )
    with_time = F.date_format(d, "yyyy-M-d HH:mm")
    # A name that is no month counts as January; May is misspelt on purpose.
    months = F.split(F.lit("January feb March APRIL Mxy June July August Sept Oct Nov Dec"), " ")
    english = F.concat(
        F.get(months, F.month(d) - 1), F.date_format(d, " d, yyyy"), F.lit(" Views: 3")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        dates.date_year_first(korean).alias("year_first"),
        dates.date_from_parts(two_digit).alias("from_parts"),
        dates.date_from_digit_runs(with_time).alias("from_runs"),
        dates.date_month_name(english).alias("month_name"),
        dates.date_from_parts(F.lit("due soon")).alias("unchanged"),
    )


@query(
    "iso_time",
    """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE strftime(ts, '.%f') END
             || '+00:00' AS iso
    FROM events
    """,
)
def iso_time(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", dates.iso_text(F.col("ts")).alias("iso")
    )


@query(
    "attachment_structs",
    f"""
    WITH names AS (
      SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL
             ELSE {sql_strip("o_orderpriority")} END AS name FROM orders)
    SELECT o_orderkey, count(name) AS n, coalesce(max(name), '') AS first_name
    FROM names GROUP BY o_orderkey
    """,
)
def attachment_structs(spark, sf):
    """Names to structs; null gives an empty list."""
    names = F.when(
        F.col("o_orderkey") % 7 != 0,
        F.array_distinct(F.array("o_orderpriority", "o_orderpriority")),
    )
    structs = text.name_structs(names)
    return (
        table(spark, sf, "orders")
        .select("o_orderkey", structs.alias("a"))
        .select(
            "o_orderkey",
            F.size("a").cast("bigint").alias("n"),
            F.coalesce(F.get("a", 0)["name"], F.lit("")).alias("first_name"),
        )
    )
