"""Queries of profile matching: who is shown what, and the pairs that batches of changes add."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.operators.matching import match_counts, new_pairs
from tidings.plans.catalog import query, table
from tidings.session import staged

FIELDS = ("major", "grade", "club")


def _users(customers):
    """A third share one major; every seventh names none, every fifth no grade."""
    key = F.col("c_custkey")
    major = F.when(key % 3 == 0, 0).otherwise(F.col("c_nationkey"))
    return customers.select(
        key.alias("user_id"),
        F.when(key % 7 != 0, major).alias("major"),
        F.when(key % 5 != 0, key % 5).alias("grade"),
        F.col("c_mktsegment").alias("club"),
    )


def _notices(parts):
    """Up to three conditions each; some have none, some an empty list."""
    key = F.col("p_partkey")
    size = F.col("p_size").cast("long")
    return parts.select(
        key.alias("notice_id"),
        F.when(key % 4 != 0, F.array(size % 25, (size * 3) % 25)).alias("major"),
        F.when(key % 3 == 1, F.array(size % 4 + 1)).when(key % 3 == 2, F.array().cast("array<bigint>")).alias("grade"),
        F.when(key % 10 == 0, F.array(F.lit("BUILDING"), F.lit("MACHINERY"))).alias("club"),
    )


_SQL_SIDES = """
    users AS (
      SELECT c_custkey AS user_id,
        CASE WHEN c_custkey % 7 <> 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END END AS major,
        CASE WHEN c_custkey % 5 <> 0 THEN c_custkey % 5 END AS grade, c_mktsegment AS club
      FROM customer),
    notices AS (
      SELECT p_partkey AS notice_id,
        CASE WHEN p_partkey % 4 <> 0 THEN [p_size % 25, (p_size * 3) % 25] ELSE [] END AS majors,
        CASE WHEN p_partkey % 3 = 1 THEN [p_size % 4 + 1] ELSE [] END AS grades,
        CASE WHEN p_partkey % 10 = 0 THEN ['BUILDING', 'MACHINERY'] ELSE [] END AS clubs
      FROM part)
"""


def _sql_passes(n: str, u: str) -> str:
    one = "(len({n}.{f}s) = 0 OR {u}.{f} IS NULL OR list_contains({n}.{f}s, {u}.{f}))"
    return " AND ".join(one.format(n=n, u=u, f=f) for f in FIELDS)


_SQL_UNCLEAR = " OR ".join(f"(len({f}s) > 0 AND {f} IS NULL)" for f in FIELDS)

SQL_MATCH = f"""
WITH {_SQL_SIDES}
SELECT notice_id, count(user_id) AS n_shown, count(*) FILTER (user_id IS NOT NULL AND ({_SQL_UNCLEAR})) AS n_unclear
FROM notices n LEFT JOIN users u ON {_sql_passes('n', 'u')} GROUP BY notice_id
"""


@query("match_profiles", SQL_MATCH)
def match_profiles(spark, sf):
    """For every notice (part), how many users (customers) see it, and for how many that is unclear."""
    notices, users = _notices(table(spark, sf, "part")), _users(table(spark, sf, "customer"))
    return match_counts(notices, users, FIELDS)


#: Notices and users that come with the second batch, and those that it changes.
_LATER, _CHANGED = 11, 13

SQL_PAIRS = f"""
WITH {_SQL_SIDES},
  old_notices AS (
    SELECT notice_id, CASE WHEN notice_id % {_CHANGED} = 1 THEN [1, 2] ELSE majors END AS majors, grades, clubs
    FROM notices WHERE notice_id % {_LATER} <> 0),
  old_users AS (
    SELECT user_id, CASE WHEN user_id % {_CHANGED} = 2 THEN 1 ELSE major END AS major, grade, club
    FROM users WHERE user_id % {_LATER} <> 0)
SELECT notice_id, user_id FROM old_notices n JOIN old_users u ON {_sql_passes('n', 'u')}
UNION
SELECT notice_id, user_id FROM notices n JOIN users u ON {_sql_passes('n', 'u')}
"""


@query("notify_pairs", SQL_PAIRS)
def notify_pairs(spark, sf):
    """Pairs to notify about over two batches: everything at first, then what is new or changed.

    Together they are the pairs that held after either batch, each once.
    """
    notices = _notices(table(spark, sf, "part"))
    users = _users(table(spark, sf, "customer"))
    new = lambda key: F.col(key) % _LATER == 0
    other_major = F.when(F.col("notice_id") % _CHANGED == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.col("major"))
    other_own = F.when(F.col("user_id") % _CHANGED == 2, 1).otherwise(F.col("major"))
    old_notices = notices.withColumn("major", other_major.cast("array<bigint>")).filter(~new("notice_id"))
    old_users = users.withColumn("major", other_own).filter(~new("user_id"))

    def changes(rows, key, changed):
        action = F.when(new(key), "insert").when(changed, "update")
        return rows.select(key, action.alias("action")).filter("action IS NOT NULL")

    all_new = lambda rows, key: rows.select(key, F.lit("insert").alias("action"))
    none = spark.createDataFrame([], "notice_id bigint, user_id bigint")
    first = new_pairs(
        old_notices, old_users, all_new(old_notices, "notice_id"), all_new(old_users, "user_id"), FIELDS, none
    )
    sent = staged(first.select("notice_id", "user_id"))
    second = new_pairs(
        notices,
        users,
        changes(notices, "notice_id", F.col("notice_id") % _CHANGED == 1),
        changes(users, "user_id", F.col("user_id") % _CHANGED == 2),
        FIELDS,
        sent,
    )
    return sent.unionByName(second.select("notice_id", "user_id"))
