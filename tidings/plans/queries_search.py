"""Queries of keyword search: ranked and phrase search over an index built from documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidings.operators.search import B, K1, SearchIndex, terms_of
from tidings.plans.catalog import query, table
from tidings.session import shared_folder

TITLE_CHARS = 60
TOP = 10
_WEIGHTS = {"title": 3.0, "body": 1.0, "hashtags": 2.0}


def _notices(documents, text="text"):
    return documents.select(
        F.col("doc_id").alias("id"),
        F.substring(text, 1, TITLE_CHARS).alias("title"),
        F.col(text).alias("body"),
        F.array("lang", "source").alias("hashtags"),
    )


def _index(spark, sf) -> SearchIndex:
    """All documents, a third of them in an older version at first; some are removed again."""
    documents = table(spark, sf, "documents")
    older = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("older draft "), F.substring("text", 50, 400)))
    index = SearchIndex(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    index.add(_notices(documents.withColumn("first", F.coalesce(older, "text")), "first"))
    stays = F.col("doc_id") % 50 != 7
    changed = _notices(documents.filter((F.col("doc_id") % 3 == 0) & stays))
    index.add(changed, documents.filter(~stays).select(F.col("doc_id").alias("id")))
    return index


def _sql_terms(text: str) -> str:
    return rf"regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+')"


_SQL_FIELDS = f"""
    fields AS (
      SELECT doc_id AS id, unnest(['title', 'body', 'hashtags']) AS field,
        unnest([{_sql_terms(f'substr(text, 1, {TITLE_CHARS})')}, {_sql_terms('text')},
                {_sql_terms("lang || ' ' || source")}]) AS terms
      FROM documents WHERE doc_id % 50 <> 7)
"""
_SQL_WEIGHT = "CASE field " + " ".join(f"WHEN '{f}' THEN {w}" for f, w in _WEIGHTS.items()) + " END"

SQL_TOPK = f"""
WITH {_SQL_FIELDS}, asked AS (
  SELECT item_id AS query_id, unnest(list_sort(list_transform(list_distinct({_sql_terms('text')}),
      lambda t: {{'l': -length(t), 't': t}}))[1:3]).t AS term FROM benchmark
), total AS (SELECT count(DISTINCT id) AS n FROM fields
), means AS (SELECT field, avg(len(terms)) AS mean FROM fields GROUP BY field
), counted AS (
  SELECT id, field, term, l, count(*) AS times
  FROM (SELECT id, field, len(terms) AS l, unnest(terms) AS term FROM fields)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT id, term, sum({_SQL_WEIGHT} * times / (1 - {B} + {B} * l / mean)) AS repeats
  FROM counted JOIN means USING (field) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM weighed GROUP BY term
), scored AS (
  SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * repeats / ({K1} + repeats)), 6) AS score
  FROM asked JOIN weighed USING (term) JOIN df USING (term), total GROUP BY ALL
)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
FROM scored QUALIFY rank <= {TOP}
"""


@query("search_topk", SQL_TOPK)
def search_topk(spark, sf):
    """The best documents for the three longest words of each benchmark item."""
    longest = F.slice(
        F.array_sort(
            F.transform(
                F.array_distinct(terms_of(F.col("text"))), lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))
            )
        ),
        1,
        3,
    )
    queries = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.array_join(longest["t"], " ").alias("text")
    )
    return _index(spark, sf).topk(queries, TOP)


SQL_PHRASE = f"""
WITH {_SQL_FIELDS}, words AS (
  SELECT id, field, unnest(terms) AS term, generate_subscripts(terms, 1) AS place FROM fields
), runs AS (
  SELECT id, [term, lead(term, 1) OVER w, lead(term, 2) OVER w, lead(term, 3) OVER w] AS run
  FROM words WINDOW w AS (PARTITION BY id, field ORDER BY place)
), asked AS (
  SELECT item_id AS query_id, ({_sql_terms('text')})[3:6] AS run FROM benchmark
  WHERE len({_sql_terms('text')}) >= 6)
SELECT query_id, id, count(*) AS n_hits FROM runs JOIN asked USING (run) GROUP BY ALL
"""


@query("search_phrase", SQL_PHRASE)
def search_phrase(spark, sf):
    """Documents that hold the third to sixth word of a benchmark item side by side."""
    found = terms_of(F.col("text"))
    queries = table(spark, sf, "benchmark").filter(F.size(found) >= 6).select(
        F.col("item_id").alias("query_id"), F.array_join(F.slice(found, 3, 4), " ").alias("text")
    )
    index = _index(spark, sf)
    index.merge()
    return index.phrases(queries)
