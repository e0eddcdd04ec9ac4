"""Registry of queries over the given tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidings.functions.text import WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` runs on DuckDB over the same tables."""

    def add(function: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL pieces shared by the oracles -----------------------------------------------------

SQL_SPACES = "'" + WHITESPACE + "'"
SQL_MARKUP = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*>.*?(?:</script\s*>|\z)"
    r"|<style\b[^>]*>.*?(?:</style\s*>|\z)"
    r"|<template\b[^>]*>.*?(?:</template\s*>|\z)"
    r"""|</?[a-z!?][^''">]*(?:(?:"[^"]*"|''[^'']*'')[^''">]*)*>"""
)


def sql_strip(text: str) -> str:
    return f"trim({text}, {SQL_SPACES})"


def sql_decode(text: str) -> str:
    pairs = (
        ("&lt;", "'<'"),
        ("&gt;", "'>'"),
        ("&quot;", "'\"'"),
        ("&nbsp;", "chr(160)"),
        ("&copy;", "chr(169)"),
        ("&middot;", "chr(183)"),
        ("&amp;", "'&'"),
    )
    for entity, char in pairs:
        text = f"replace({text}, '{entity}', {char})"
    return text


def sql_visible(html: str, separator: str = "chr(10)") -> str:
    broken = sql_decode(f"regexp_replace({html}, '{SQL_MARKUP}', chr(1), 'g')")
    nodes = f"list_transform(string_split({broken}, chr(1)), lambda x: {sql_strip('x')})"
    return f"array_to_string(list_filter({nodes}, lambda x: x <> ''), {separator})"


def sql_content_hash(title: str, html: str) -> str:
    return f"sha256({title} || chr(10) || coalesce({sql_visible(html)}, ''))"


def sql_external_id(url: str) -> str:
    query_part = rf"regexp_extract({url}, '^[^?#]*\?([^#]*)', 1)"
    keys = ", ".join(
        f"nullif(regexp_extract({query_part}, '(?:^|&){k}=([^&]+)', 1), '')"
        for k in ("articleNo", "article_no", "no", "id", "idx")
    )
    bare = rf"regexp_replace({url}, '[?#].*$', '')"
    path = rf"regexp_replace({bare}, '^[a-z]+://[^/]*', '')"
    segment = rf"regexp_extract(regexp_replace({path}, '/+$', ''), '([^/]*)$', 1)"
    return (
        f"coalesce({keys}, CASE WHEN regexp_full_match({segment}, '[\\p{{L}}\\p{{N}}]+') "
        f"THEN {segment} END, substr(sha256({bare}), 1, 32))"
    )
