"""Table schemas. Timestamps are UTC; nested values are arrays of structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

IMAGES = "array<struct<type:string,data:string,ext:string,name:string>>"
ATTACHMENTS = "array<struct<name:string>>"

PAGES = "page_id bigint, source_code string, url string, html string, fetched_at timestamp"

NOTICES = (
    "id bigint, source_code string, external_id string, title string, url string,"
    f" published_at timestamp, raw_html string, images {IMAGES}, attachments {ATTACHMENTS},"
    " dates array<struct<type:string,date:string>>, eligibility array<string>,"
    " ai_extracted_json string, hashtags array<string>, content_hash string,"
    " is_manual_edited boolean, created_at timestamp, updated_at timestamp"
)

RUNS = (
    "id bigint, source_id bigint, task_id string, started_at timestamp, finished_at timestamp,"
    " status string, notices_upserted int, error_message string"
)

USERS = (
    "id bigint, provider string, provider_user_id string, email string, name string,"
    " profile struct<major:string,grade:int,military_served:boolean,gpa:double>,"
    " created_at timestamp, updated_at timestamp"
)

SAVED_EVENTS = (
    "id bigint, user_id bigint, notice_id bigint, title string, start_at timestamp,"
    " end_at timestamp, created_at timestamp"
)

# Natural key of a notice.
NOTICE_KEY = ("source_code", "external_id")

# Columns an update replaces, and columns only enrichment and editors write.
UPDATED_COLUMNS = (
    "title", "url", "raw_html", "images", "attachments", "content_hash", "published_at",
)
KEPT_COLUMNS = (
    "id", "dates", "eligibility", "ai_extracted_json", "hashtags", "is_manual_edited",
    "created_at",
)

# Stored lengths.
LENGTH_LIMITS = {"external_id": 512, "title": 512, "url": 2048}


def conform(rows: DataFrame, ddl: str) -> DataFrame:
    """Project rows to a schema: columns in its order and types, missing ones as null."""
    return rows.select(
        *[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(ddl)
        ]
    )
