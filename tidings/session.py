"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows that are few enough to go to every task, whatever their files' size.
FEW = 20_000
#: Writer's options for rows that hold pages.
PACKED = {"compression": "zstd"}


def build_session(app: str = "tidings", **conf) -> SparkSession:
    """Session for local use and tests; on a cluster the submitted settings stay in force."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Spark 4.1 can plan a join over a union of unequal partition counts and then fail.
        .config("spark.sql.unionOutputPartitioning", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where that setting is absent and Spark runs in one process, as in tests, a folder beside
    the warehouse takes its place and is set as such for the session.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    beside = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}-shared"
    spark.conf.set("spark.checkpoint.dir", beside)
    return beside


def staged(rows: DataFrame, path: str | None = None, **options: str) -> DataFrame:
    """Write rows once to the shared folder and read them back.

    Used where several outputs need the same expensive rows: the lineage is cut, a lost
    executor does not lose them, and filters on extracted columns become filters on a file
    scan instead of a second evaluation of the extraction. ``options`` are the writer's.
    """
    path = path or f"{shared_folder(rows.sparkSession)}/stage-{uuid.uuid4().hex}"
    rows.write.options(**options).mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def sent(rows: DataFrame) -> DataFrame:
    """Narrow staged rows for a join with wide ones: to every task if they are few, else shuffled and hashed.

    Spark takes a filtered file to be as large as the whole, and sorts both sides of a large join; the wide
    side is neither shuffled nor sorted without need.
    """
    return rows.hint("broadcast" if rows.limit(FEW + 1).count() <= FEW else "shuffle_hash")
