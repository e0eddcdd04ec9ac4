"""Queries for records, de-duplication, upserts, run log, lookups, deletes and checks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidings.functions.text import content_hash, name_structs
from tidings.operators import evolve, integrity, lookup
from tidings.operators.dedup import first_seen
from tidings.operators.delete import delete_from_store, delete_range
from tidings.operators.payload import (
    MAX_HTML_BYTES,
    PLACEHOLDER_TITLES,
    build_payload,
    judged,
    rejects,
)
from tidings.operators.runs import recent_runs, update_runs
from tidings.operators.sources import seed_missing, split_unknown
from tidings.operators.upsert import (
    changed,
    classify,
    counts,
    fold_sign_ins,
    upsert_notices,
    upsert_users,
)
from tidings.plans.catalog import query, sql_content_hash, table
from tidings.plans.crawl import read_runs
from tidings.plans.sites import SITES
from tidings.schema import LENGTH_LIMITS, NOTICES, RUNS, conform
from tidings.session import shared_folder
from tidings.sources.pages import decoded
from tidings.sources.store import NoticeStore

BATCH_TS = "2024-06-01 00:00:00"
STORED_TS = "2024-01-01 00:00:00"
OVERSIZE = MAX_HTML_BYTES + 1  # what is put before the text of some documents

# --- records: accept, reject ---------------------------------------------------------------

_SQL_POSTS = f"""
    posts AS (
      SELECT doc_id, source AS source_code,
        CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 11 = 1 THEN '   '
             WHEN doc_id % 11 = 2 THEN ' {PLACEHOLDER_TITLES[0]} '
             WHEN doc_id % 11 = 3 THEN '{PLACEHOLDER_TITLES[1]}'
             ELSE 'Notice ' || doc_id END AS title,
        'https://n.example.org/view?idx=' || doc_id AS url, 
        CASE WHEN doc_id % 199 = 5 THEN repeat('x', {OVERSIZE}) || text ELSE text END AS html,
        '2024.' || (doc_id % 14) || '.' || (doc_id % 28 + 1) AS date_str
      FROM documents),
    judged AS (
      SELECT *, CASE WHEN title = '' THEN 'empty_title'
                     WHEN strlen(html) > {MAX_HTML_BYTES} THEN 'too_large'
                     WHEN trim(title) IN ('', '{PLACEHOLDER_TITLES[0]}', '{PLACEHOLDER_TITLES[1]}')
                       THEN 'placeholder' END AS reason
      FROM posts)
"""


def _posts(spark, sf):
    """Scraped posts made from documents: planted empty and placeholder titles."""
    doc = F.col("doc_id")
    title = (
        F.when(doc % 11 == 0, "")
        .when(doc % 11 == 1, "   ")
        .when(doc % 11 == 2, f" {PLACEHOLDER_TITLES[0]} ")
        .when(doc % 11 == 3, PLACEHOLDER_TITLES[1])
        .otherwise(F.concat(F.lit("Notice "), doc))
    )
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("source").alias("source_code"),
        F.lit("").alias("no"),
        F.concat(F.lit("https://n.example.org/view?idx="), doc).alias("url"),
        title.alias("title"),
        F.concat(F.lit("2024."), doc % 14, F.lit("."), doc % 28 + 1).alias("date_str"),
        F.when(doc % 199 == 5, F.concat(F.repeat(F.lit("x"), OVERSIZE), "text"))
        .otherwise(F.col("text"))
        .alias("html"),
        F.lit(None).cast("array<struct<type:string,data:string,ext:string,name:string>>").alias("images"),
        F.array(F.lit("a.pdf")).alias("attachment_names"),
    )


@query(
    "payload_accept",
    f"""
    WITH {_SQL_POSTS}
    SELECT source_code, CAST(doc_id AS VARCHAR) AS external_id, title, url,
           {sql_content_hash('title', 'html')} AS content_hash, 'a.pdf' AS attachment,
           CASE WHEN doc_id % 14 BETWEEN 1 AND 12 AND (doc_id % 14 <> 2 OR doc_id % 28 + 1 <= 29)
                THEN '2024-' || lpad(CAST(doc_id % 14 AS VARCHAR), 2, '0') || '-'
                     || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS published_on
    FROM judged WHERE reason IS NULL
    """,
)
def payload_accept(spark, sf):
    records = build_payload(judged(_posts(spark, sf)))
    return records.select(
        "source_code",
        "external_id",
        "title",
        "url",
        "content_hash",
        F.get("attachments", 0)["name"].alias("attachment"),
        F.date_format("published_at", "yyyy-MM-dd").alias("published_on"),
    )


@query(
    "payload_reject",
    f"WITH {_SQL_POSTS} SELECT source_code, url, reason, substr(title, 1, 80) AS detail "
    "FROM judged WHERE reason IS NOT NULL",
)
def payload_reject(spark, sf):
    return rejects(judged(_posts(spark, sf)))


# --- de-duplication ------------------------------------------------------------------------

_LINE_KEY = ["l_orderkey", "l_linenumber"]
_LINE_REST = [
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus",
]


@query(
    "first_seen",
    f"""
    SELECT {', '.join(_LINE_KEY + _LINE_REST)} FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY {', '.join(_LINE_KEY)} ORDER BY {', '.join(_LINE_REST)}) = 1
    """,
)
def first_seen_lines(spark, sf):
    """First copy of every repeated key, in a total order."""
    rows = table(spark, sf, "lineitem").select(*_LINE_KEY, *_LINE_REST)
    return first_seen(rows, _LINE_KEY, [F.asc(c) for c in _LINE_REST])


@query(
    "attachments_by_order",
    """
    SELECT l_orderkey, p_name AS name, min(l_linenumber) AS first_line
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_name
    """,
)
def attachments_by_order(spark, sf):
    """Names per order, each once, at the place where it is first seen."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    named = (
        table(spark, sf, "lineitem")
        .select("l_orderkey", "l_partkey", "l_linenumber")
        .join(parts, "l_partkey")
    )
    once = named.groupBy("l_orderkey", "p_name").agg(F.min("l_linenumber").alias("first_line"))
    structs = once.withColumn("a", F.get(name_structs(F.array("p_name")), 0))
    return structs.select("l_orderkey", F.col("a.name").alias("name"), "first_line")


# --- upserts --------------------------------------------------------------------------------

_SQL_TABLES = f"""
    stored AS (
      SELECT source AS source_code, CAST(doc_id AS VARCHAR) AS external_id,
        'Notice ' || doc_id AS title, 'https://n.example.org/' || doc_id AS url, text AS raw_html,
        CASE WHEN lang <> 'de' THEN {sql_content_hash("'Notice ' || doc_id", 'text')} END AS content_hash,
        CASE WHEN lang = 'en' THEN 'tag' END AS hashtag, source < 'src15' AS is_manual_edited
      FROM documents SEMI JOIN labels USING (doc_id)),
    batch AS (
      SELECT source AS source_code, CAST(doc_id AS VARCHAR) AS external_id,
        'Notice ' || doc_id AS title, 'https://n.example.org/new/' || doc_id AS url, new_text AS raw_html,
        {sql_content_hash("'Notice ' || doc_id", "new_text")} AS content_hash
      FROM (SELECT *, CASE WHEN n_chars % 3 = 0 THEN text || ' changed' ELSE text END AS new_text
            FROM documents WHERE lang <> 'es')),
    marks AS (
      SELECT coalesce(b.source_code, s.source_code) AS source_code,
        coalesce(b.external_id, s.external_id) AS external_id,
        CASE WHEN b.external_id IS NULL THEN 'absent' WHEN s.external_id IS NULL THEN 'insert'
             WHEN s.content_hash IS DISTINCT FROM b.content_hash THEN 'update' ELSE 'keep' END AS action,
        s.title AS s_title, s.url AS s_url, s.content_hash AS s_hash, s.hashtag,
        s.is_manual_edited, b.title AS b_title, b.url AS b_url, b.content_hash AS b_hash,
        sha256(s.raw_html) AS s_html, sha256(b.raw_html) AS b_html
      FROM stored s FULL JOIN batch b
        ON s.source_code = b.source_code AND s.external_id = b.external_id)
"""


def _upserted(taken: str) -> str:
    return f"""
    WITH {_SQL_TABLES}
    SELECT source_code, external_id,
      CASE WHEN {taken} THEN b_title ELSE s_title END AS title,
      CASE WHEN {taken} THEN b_url ELSE s_url END AS url,
      CASE WHEN {taken} THEN b_html ELSE s_html END AS html_hash,
      CASE WHEN {taken} THEN b_hash ELSE s_hash END AS content_hash,
      hashtag, coalesce(is_manual_edited, false) AS is_manual_edited,
      CASE WHEN action = 'insert' THEN '{BATCH_TS}' ELSE '{STORED_TS}' END AS created_at,
      CASE WHEN {taken} THEN '{BATCH_TS}' ELSE '{STORED_TS}' END AS updated_at
    FROM marks
    """


def _record(doc, html, url):
    title = F.concat(F.lit("Notice "), doc)
    return [
        F.col("source").alias("source_code"),
        doc.cast("string").alias("external_id"),
        title.alias("title"),
        F.concat(F.lit(url), doc).alias("url"),
        html.alias("raw_html"),
        content_hash(title, html).alias("content_hash"),
    ]


def _stored(spark, sf):
    """Notice table before the batch: the labelled documents; German ones have no hash."""
    labels = table(spark, sf, "labels").select("doc_id")
    lang = F.col("lang")
    stamp = F.lit(STORED_TS).cast("timestamp")
    rows = table(spark, sf, "documents").join(labels, "doc_id", "left_semi").select(
        *_record(F.col("doc_id"), F.col("text"), "https://n.example.org/"),
        F.when(lang == "en", F.array(F.lit("tag"))).alias("hashtags"),
        (F.col("source") < "src15").alias("is_manual_edited"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
        lang.alias("_lang"),
    )
    hashed = F.when(F.col("_lang") != "de", F.col("content_hash"))
    return conform(rows.withColumn("content_hash", hashed), NOTICES)


def _batch(spark, sf):
    """Incoming records: all but the Spanish documents, with new urls and some new texts."""
    html = F.when(F.col("n_chars") % 3 == 0, F.concat("text", F.lit(" changed"))).otherwise(
        F.col("text")
    )
    rows = table(spark, sf, "documents").filter(F.col("lang") != "es")
    return rows.select(
        *_record(F.col("doc_id"), html, "https://n.example.org/new/"),
        F.array().cast("array<struct<type:string,data:string,ext:string,name:string>>").alias("images"),
        F.array().cast("array<struct<name:string>>").alias("attachments"),
        F.lit(None).cast("timestamp").alias("published_at"),
    )


def _shown(notices):
    ts = "yyyy-MM-dd HH:mm:ss"
    return notices.select(
        "source_code",
        "external_id",
        "title",
        "url",
        F.sha2("raw_html", 256).alias("html_hash"),
        "content_hash",
        F.get("hashtags", 0).alias("hashtag"),
        F.coalesce("is_manual_edited", F.lit(False)).alias("is_manual_edited"),
        F.date_format("created_at", ts).alias("created_at"),
        F.date_format("updated_at", ts).alias("updated_at"),
    )


@query("upsert_guarded", _upserted("action IN ('insert', 'update')"))
def upsert_guarded(spark, sf):
    """Table after the batch: equal hashes leave the stored row, url included."""
    return _shown(upsert_notices(_stored(spark, sf), _batch(spark, sf), BATCH_TS))


@query("upsert_unconditional", _upserted("action IN ('insert', 'update', 'keep')"))
def upsert_unconditional(spark, sf):
    """Table after the batch without the hash guard: every incoming row is written."""
    return _shown(upsert_notices(_stored(spark, sf), _batch(spark, sf), BATCH_TS, guard=False))


@query(
    "upsert_protected",
    _upserted("action = 'insert' OR (action = 'update' AND NOT coalesce(is_manual_edited, false))"),
)
def upsert_protected(spark, sf):
    """The option that leaves rows edited by hand alone."""
    merged = upsert_notices(
        _stored(spark, sf), _batch(spark, sf), BATCH_TS, protect_manual_edits=True
    )
    return _shown(merged)


@query(
    "upsert_changed",
    f"WITH {_SQL_TABLES} SELECT source_code, external_id, action FROM marks "
    "WHERE action IN ('insert', 'update')",
)
def upsert_changed(spark, sf):
    """Feed of new and changed keys; bodies do not travel."""
    return changed(classify(_stored(spark, sf), _batch(spark, sf)))


@query(
    "upsert_counts",
    f"""WITH {_SQL_TABLES}
    SELECT count(*) AS upserted, count(*) FILTER (action <> 'keep') AS n_changed
    FROM marks WHERE action <> 'absent'""",
)
def upsert_counts(spark, sf):
    return counts(classify(_stored(spark, sf), _batch(spark, sf)))


@query(
    "user_upsert",
    """
    WITH stored AS (
      SELECT CAST(c_custkey AS VARCHAR) AS uid, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name || '@x' END AS email,
        c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS major
      FROM customer WHERE c_mktsegment <> 'BUILDING'),
    claims AS (
      SELECT CAST(o_custkey AS VARCHAR) AS uid, o_orderkey AS seq,
        CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'm' || o_orderkey END AS email,
        CASE WHEN o_orderkey % 4 = 0 THEN 'n' || o_orderkey ELSE '' END AS name,
        CASE WHEN o_orderkey % 6 = 0 THEN o_orderpriority END AS major
      FROM orders),
    folded AS (
      SELECT uid,
        coalesce(arg_max(email, seq) FILTER (email IS NOT NULL AND email <> ''), first(email ORDER BY seq)) AS email,
        coalesce(arg_max(name, seq) FILTER (name IS NOT NULL AND name <> ''), first(name ORDER BY seq)) AS name,
        arg_max(major, seq) FILTER (major IS NOT NULL) AS major
      FROM claims GROUP BY uid)
    SELECT coalesce(s.uid, f.uid) AS provider_user_id,
      CASE WHEN s.uid IS NULL THEN f.email ELSE coalesce(nullif(f.email, ''), s.email) END AS email,
      CASE WHEN s.uid IS NULL THEN f.name ELSE coalesce(nullif(f.name, ''), s.name) END AS name,
      coalesce(f.major, s.major) AS major
    FROM stored s FULL JOIN folded f ON s.uid = f.uid
    """,
)
def user_upsert(spark, sf):
    """Users from customers, a feed of claims from orders; blanks never overwrite."""
    key, order = F.col("c_custkey"), F.col("o_orderkey")

    def profile(major):
        kind = "struct<major:string,grade:int,military_served:boolean,gpa:double>"
        return F.when(
            major.isNotNull(),
            F.struct(
                major.alias("major"),
                F.lit(None).cast("int").alias("grade"),
                F.lit(None).cast("boolean").alias("military_served"),
                F.lit(None).cast("double").alias("gpa"),
            ),
        ).cast(kind).alias("profile")

    stored = table(spark, sf, "customer").filter(F.col("c_mktsegment") != "BUILDING").select(
        F.lit("google").alias("provider"),
        key.cast("string").alias("provider_user_id"),
        F.when(key % 4 != 0, F.concat("c_name", F.lit("@x"))).alias("email"),
        F.col("c_name").alias("name"),
        profile(F.when(key % 3 == 0, F.col("c_mktsegment"))),
    )
    claims = table(spark, sf, "orders").select(
        F.lit("google").alias("provider"),
        F.col("o_custkey").cast("string").alias("provider_user_id"),
        order.alias("seq"),
        F.when(order % 3 == 0, "").when(order % 3 == 2, F.concat(F.lit("m"), order)).alias("email"),
        F.when(order % 4 == 0, F.concat(F.lit("n"), order)).otherwise("").alias("name"),
        profile(F.when(order % 6 == 0, F.col("o_orderpriority"))),
    )
    folded = fold_sign_ins(claims, ["provider", "provider_user_id"], "seq")
    users = upsert_users(stored, folded)
    return users.select("provider_user_id", "email", "name", F.col("profile.major").alias("major"))


@query(
    "seed_absent",
    """
    SELECT n_name, CASE WHEN n_regionkey = 1 THEN 'old ' || n_nationkey
                        ELSE CAST(n_nationkey AS VARCHAR) END AS label
    FROM nation
    """,
)
def seed_absent(spark, sf):
    """Insert what is absent, leave what exists."""
    nation = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    existing = nation.filter(F.col("n_regionkey") == 1).select(
        "n_name", F.concat(F.lit("old "), key).alias("label")
    )
    seed = nation.select("n_name", key.cast("string").alias("label"))
    return seed_missing(existing, seed, "n_name")


# --- run log --------------------------------------------------------------------------------

_STATUS = {"P": "running", "O": "failed", "F": "success"}


def _runs(spark, sf):
    """Orders as runs of their customers."""
    status = F.col("o_orderstatus")
    known = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    finished = F.col("o_orderdate").cast("timestamp") + F.make_interval(
        mins=(F.col("o_orderkey") % 50).cast("int")
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("source_id"),
        F.concat(F.lit("t"), (F.col("o_orderkey") / 2).cast("bigint")).alias("task_id"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
        F.when(status != "P", finished).alias("finished_at"),
        F.element_at(known, status).alias("status"),
        (F.col("o_orderkey") % 100).cast("int").alias("notices_upserted"),
        F.when(status == "O", F.concat(F.lit("error "), F.col("o_orderkey"))).alias("error_message"),
    )


_SQL_RUNS = """
    runs AS (
      SELECT o_orderkey AS id, o_custkey AS source_id, 't' || (o_orderkey // 2) AS task_id,
        o_orderdate AS started_at,
        CASE WHEN o_orderstatus <> 'P' THEN o_orderdate + to_minutes(o_orderkey % 50) END AS finished_at,
        CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'failed' ELSE 'success' END AS status,
        CAST(o_orderkey % 100 AS INTEGER) AS notices_upserted,
        CASE WHEN o_orderstatus = 'O' THEN 'error ' || o_orderkey END AS error_message
      FROM orders)
"""


@query(
    "recent_runs",
    f"""
    WITH {_SQL_RUNS}
    SELECT c_name AS source_code, strftime(started_at, '%Y-%m-%dT%H:%M:%S+00:00') AS started_at,
      strftime(finished_at, '%Y-%m-%dT%H:%M:%S+00:00') AS finished_at, status, notices_upserted,
      error_message
    FROM runs JOIN customer ON c_custkey = source_id
    ORDER BY runs.started_at DESC, id LIMIT 50
    """,
)
def recent_runs_report(spark, sf):
    sources = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("external_id")
    )
    return recent_runs(_runs(spark, sf), sources)


@query(
    "run_update",
    f"""
    WITH {_SQL_RUNS},
    updates AS (
      SELECT DISTINCT 't' || (o_orderkey // 2) AS task_id,
        CASE WHEN (o_orderkey // 2) % 3 = 0 THEN 'success' END AS status,
        CASE WHEN (o_orderkey // 2) % 3 <> 2 THEN CAST((o_orderkey // 2) % 10 AS INTEGER) END AS notices_upserted,
        CASE WHEN (o_orderkey // 2) % 3 = 1 THEN repeat('e', 2500) END AS error_message
      FROM orders WHERE o_orderstatus = 'P'),
    marked AS (
      SELECT r.*, started_at = max(started_at) OVER (PARTITION BY task_id) AS latest FROM runs r)
    SELECT m.id, coalesce(u.status, m.status) AS status,
      coalesce(u.notices_upserted, m.notices_upserted) AS notices_upserted,
      coalesce(substr(u.error_message, 1, 2000), m.error_message) AS error_message
    FROM marked m LEFT JOIN updates u ON u.task_id = m.task_id AND m.latest
    """,
)
def run_update(spark, sf):
    """Partial updates of the latest run of a task; nulls change nothing."""
    task = (F.col("o_orderkey") / 2).cast("bigint")
    updates = (
        table(spark, sf, "orders")
        .filter(F.col("o_orderstatus") == "P")
        .select(task.alias("t"))
        .distinct()
        .select(
            F.concat(F.lit("t"), F.col("t")).alias("task_id"),
            F.lit(None).cast("timestamp").alias("finished_at"),
            F.when(F.col("t") % 3 == 0, "success").alias("status"),
            F.when(F.col("t") % 3 != 2, (F.col("t") % 10).cast("int")).alias("notices_upserted"),
            F.when(F.col("t") % 3 == 1, F.repeat(F.lit("e"), 2500)).alias("error_message"),
        )
    )
    return update_runs(_runs(spark, sf), updates).select(
        "id", "status", "notices_upserted", "error_message"
    )


# --- lookups --------------------------------------------------------------------------------


@query(
    "latest_n",
    """
    SELECT event_id, ts, substr(props, 1, 50) AS preview FROM events
    ORDER BY ts DESC, event_id LIMIT 5
    """,
)
def latest_n(spark, sf):
    return lookup.newest(table(spark, sf, "events"), "ts", "event_id", "props")


@query("point_lookup", "SELECT * FROM orders WHERE o_orderkey = 5")
def point_lookup(spark, sf):
    return lookup.by_columns(table(spark, sf, "orders"), o_orderkey=5)


@query("key_lookup", "SELECT * FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def key_lookup(spark, sf):
    return lookup.by_columns(table(spark, sf, "lineitem"), l_orderkey=7, l_linenumber=1)


@query(
    "bulk_lookup",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    """,
)
def bulk_lookup(spark, sf):
    """Users that occur in a feed of keys."""
    running = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P")
    wanted = running.select(F.col("o_custkey").alias("c_custkey"))
    users = table(spark, sf, "customer").select("c_custkey", "c_name")
    return lookup.by_keys(users, wanted, ["c_custkey"])


@query(
    "source_lookup",
    "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey",
)
def source_lookup(spark, sf):
    """Rows with the code of their source."""
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return (
        table(spark, sf, "supplier").join(nation, "s_nationkey").select("s_suppkey", "s_name", "n_name")
    )


@query(
    "enrich_pending",
    """
    SELECT d.doc_id, md5(d.text) AS text_hash FROM documents d
    WHERE d.lang = 'en' AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
      AND d.doc_id % 3 <> 1
    """,
)
def enrich_pending(spark, sf):
    """Changed notices still to enrich: not done, and extraction missing or empty."""
    doc = F.col("doc_id")
    documents = table(spark, sf, "documents")
    notices = documents.select(
        "doc_id",
        "text",
        F.when(doc % 3 == 0, "{}").when(doc % 3 == 1, '{"major": 1}').alias("ai_extracted_json"),
    )
    keys = documents.filter(F.col("lang") == "en").select("doc_id")
    # At-least-once feed: every key twice, and one that has no notice.
    feed = keys.unionByName(keys).unionByName(keys.select((-1 - doc).alias("doc_id")))
    done = table(spark, sf, "labels").select("doc_id")
    pending = lookup.enrich_pending(feed, notices, done, key="doc_id")
    return pending.select("doc_id", F.md5("text").alias("text_hash"))


@query(
    "unknown_code",
    """
    SELECT source AS source_code, count(*) AS n FROM documents
    WHERE source NOT IN (SELECT 'src' || r_regionkey FROM region)
    GROUP BY source
    """,
)
def unknown_code(spark, sf):
    """Rows of sources the registry does not have."""
    known = table(spark, sf, "region").select(
        F.concat(F.lit("src"), F.col("r_regionkey")).alias("external_id")
    )
    # Counted before the join, so a source with very many rows is one row per task.
    per_source = (
        table(spark, sf, "documents")
        .groupBy(F.col("source").alias("source_code"))
        .agg(F.count("*").alias("n"))
    )
    _, unknown = split_unknown(per_source, known)
    return unknown


# --- deletes --------------------------------------------------------------------------------

_DELETE_BOUNDS = ("1998-01-01", "1993-01-01")
_SQL_HIT = (
    f"o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '{_DELETE_BOUNDS[0]}' "
    f"AND o_orderdate > TIMESTAMP '{_DELETE_BOUNDS[1]}'"
)
_SQL_USED = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"


def _deletion(spark, sf):
    references = (
        table(spark, sf, "lineitem")
        .filter(F.col("l_returnflag") == "R")
        .select(F.col("l_orderkey").alias("o_orderkey"))
    )
    return delete_range(
        table(spark, sf, "orders"),
        "o_orderstatus",
        "F",
        "o_orderdate",
        before=_DELETE_BOUNDS[0],
        after=_DELETE_BOUNDS[1],
        references=references,
        key="o_orderkey",
    )


@query(
    "delete_range",
    f"SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE NOT ({_SQL_HIT} AND NOT {_SQL_USED})",
)
def delete_range_kept(spark, sf):
    """The table after the deletion; referenced rows stay."""
    return _deletion(spark, sf).kept.select("o_orderkey", "o_orderstatus", "o_orderdate")


@query(
    "delete_report",
    f"""
    SELECT count(*) FILTER (NOT used) AS deleted, count(*) FILTER (used) AS blocked
    FROM (SELECT {_SQL_USED} AS used FROM orders WHERE {_SQL_HIT})
    """,
)
def delete_report(spark, sf):
    done = _deletion(spark, sf)
    both = done.deleted.select(F.lit(0).alias("b")).unionByName(
        done.blocked.select(F.lit(1).alias("b"))
    )
    return both.agg(
        F.count_if(F.col("b") == 0).alias("deleted"), F.count_if(F.col("b") == 1).alias("blocked")
    )


_CODES = ", ".join(f"'{s.code}'" for s in SITES)


@query(
    "store_delete",
    f"""
    WITH n AS (
      SELECT o_orderkey AS id, [{_CODES}][o_orderkey % 7 + 1] AS source_code,
             CAST(o_orderkey AS VARCHAR) AS external_id, o_orderdate AS created_at FROM orders)
    SELECT id, source_code, external_id FROM n
    WHERE NOT (source_code = 'glc' AND created_at < TIMESTAMP '{_DELETE_BOUNDS[0]}'
               AND created_at > TIMESTAMP '{_DELETE_BOUNDS[1]}')
    """,
)
def store_delete(spark, sf):
    """Notices made from orders are stored, one source's are deleted by date, the rest read back."""
    codes = F.array(*[F.lit(s.code) for s in SITES])
    notices = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.get(codes, (F.col("o_orderkey") % 7).cast("int")).alias("source_code"),
        F.col("o_orderkey").cast("string").alias("external_id"),
        F.col("o_orderdate").alias("created_at"),
    )
    store = NoticeStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}").create()
    store.write(conform(notices, NOTICES), [s.code for s in SITES])
    before, after = _DELETE_BOUNDS
    delete_from_store(store, "glc", SITES, before=before, after=after)
    return store.read().select("id", "source_code", "external_id")


# --- run log, raw pages ---------------------------------------------------------------------


@query(
    "run_log",
    """
    SELECT 'task ' || o_custkey AS task_id,
      strftime(TIMESTAMP '2024-01-01' + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S') AS started,
      CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' ELSE 'running' END AS status,
      CAST(CASE WHEN o_orderstatus = 'O' THEN o_orderkey % 50 ELSE 0 END AS INTEGER) AS notices_upserted,
      CASE WHEN o_orderstatus = 'F' THEN 'boom ' || o_orderkey END AS error_message
    FROM orders
    """,
)
def run_log(spark, sf):
    """The run log of tasks that fail, are tried again and succeed: an attempt per order."""
    order, state = F.col("o_orderkey"), F.col("o_orderstatus")
    started = (F.lit("2024-01-01").cast("timestamp").cast("long") + order).cast("timestamp")
    attempts = table(spark, sf, "orders").select(
        F.concat(F.lit("task "), "o_custkey").alias("task_id"),
        started.alias("started_at"),
        F.lit("running").alias("status"),
        F.lit(0).alias("notices_upserted"),
        state.alias("state"),
        order.alias("id"),
    )
    done = attempts.filter("state IN ('F', 'O')").select(
        "task_id",
        "started_at",
        F.expr("started_at + INTERVAL 1 MINUTE").alias("finished_at"),
        F.when(F.col("state") == "F", "failed").otherwise("success").alias("status"),
        F.when(F.col("state") == "O", F.col("id") % 50).cast("int").alias("notices_upserted"),
        F.when(F.col("state") == "F", F.concat(F.lit("boom "), "id")).alias("error_message"),
    )
    log = f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    conform(attempts, RUNS).write.parquet(f"{log}/runs")
    done.write.parquet(f"{log}/updates")
    return read_runs(spark, log).select(
        "task_id",
        F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started"),
        "status",
        "notices_upserted",
        "error_message",
    )


@query(
    "decode_bytes",
    """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0
                        THEN '가' || regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') || chr(65533)
                        ELSE text || chr(65533) END AS html
    FROM documents
    """,
)
def decode_bytes(spark, sf):
    """Raw pages in the charset of their source, each with a byte at its end that is none."""
    korean = F.col("doc_id") % 3 == 0
    ascii_only = F.regexp_replace("text", "[^\\x00-\\x7F]", "")
    raw = F.when(korean, F.concat(F.unhex(F.lit("B0A1")), F.encode(ascii_only, "UTF-8")))
    raw = raw.otherwise(F.encode("text", "UTF-8"))
    pages = table(spark, sf, "documents").select(
        "doc_id",
        F.when(korean, "business").otherwise("glc").alias("source_code"),
        F.concat(raw, F.unhex(F.lit("FF"))).alias("content"),
    )
    return decoded(pages, SITES).select("doc_id", "html")


# --- checks ---------------------------------------------------------------------------------


@query(
    "check_unique",
    """
    SELECT 'lineitem' AS "table", 'unique' AS rule, l_orderkey || '|' || l_linenumber AS key,
           count(*) AS n
    FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    """,
)
def check_unique(spark, sf):
    return integrity.check_unique(table(spark, sf, "lineitem"), "lineitem", _LINE_KEY)


@query(
    "check_fk",
    """
    SELECT 'orders' AS "table", 'foreign_key' AS rule, CAST(o_custkey AS VARCHAR) AS key, count(*) AS n
    FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
    GROUP BY o_custkey
    """,
)
def check_fk(spark, sf):
    """Orders whose customer is missing among those with a balance."""
    parents = table(spark, sf, "customer").filter(F.col("c_acctbal") >= 0)
    return integrity.check_foreign_key(
        table(spark, sf, "orders"), "orders", "o_custkey", parents, "c_custkey"
    )


@query(
    "check_rules",
    f"""
    WITH d AS (SELECT doc_id, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE text END AS title,
                      source FROM documents)
    SELECT 'documents' AS "table", rule, '' AS key, n FROM (
      SELECT 'not_null(title)' AS rule, count(*) FILTER (title IS NULL) AS n FROM d
      UNION ALL SELECT 'max_length(title)', count(*) FILTER (length(title) > {LENGTH_LIMITS['title']}) FROM d
      UNION ALL SELECT 'not_null(source)', count(*) FILTER (source IS NULL) FROM d)
    WHERE n > 0
    """,
)
def check_rules(spark, sf):
    """Null and length rules, one pass over the table."""
    rows = table(spark, sf, "documents").select(
        F.when(F.col("doc_id") % 8 != 0, F.col("text")).alias("title"), "source"
    )
    rules = (
        integrity.not_null("title")
        | integrity.max_length("title", LENGTH_LIMITS["title"])
        | integrity.not_null("source")
    )
    return integrity.check_rules(rows, "documents", rules)


@query(
    "quality_gate",
    """
    WITH g AS (
      SELECT sha256(text) AS h, count(*) AS n, count(*) FILTER (doc_id % 6 = 0) AS undated
      FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n_rows,
      CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_repeated_rows,
      count(*) FILTER (n > 1) AS n_repeated_hashes, CAST(sum(undated) AS BIGINT) AS n_without_date
    FROM g
    """,
)
def quality_gate(spark, sf):
    doc = F.col("doc_id")
    rows = table(spark, sf, "documents").select(
        F.sha2("text", 256).alias("content_hash"),
        F.when(doc % 6 != 0, F.lit("2024-01-01").cast("date")).alias("published_at"),
    )
    return integrity.quality_gate(rows)


@query(
    "evolve_schema",
    """
    SELECT event_id, ts, user_id, value, 'unknown' AS channel, false AS is_manual_edited,
           CAST(NULL AS VARCHAR) AS content_hash
    FROM events
    """,
)
def evolve_schema(spark, sf):
    """Add columns with and without default, drop two, require one."""
    events = table(spark, sf, "events")
    wider = evolve.add_columns(
        events,
        {
            "channel": ("string", "unknown"),
            "is_manual_edited": ("boolean", False),
            "content_hash": ("string", None),
        },
    )
    return evolve.require_columns(evolve.drop_columns(wider, "props", "event_type"), "ts")
