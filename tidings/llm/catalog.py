"""Registry of the training-data queries, and what their operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Rows of one Arrow batch: bounds what a Python task holds when documents are very long.
BATCH_ROWS = 400


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    # Spark 4.1 can plan a join over a union of unequal partition counts and then fail.
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` runs on DuckDB over the same tables."""

    def add(function: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: function(prepared(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(rows: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone; others, however they are called, stay out of an operator."""
    return rows.select(*(F.col(f"`{c}`") for c in columns))


def unused(rows: DataFrame, name: str) -> str:
    """``name``, under as many underscores as make it differ from every column of ``rows``."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def in_arrow(rows: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work`` maps a record batch to a dict of columns; rows stay in their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield record_batch(work(batch), target)

    target = arrow_schema(schema)
    return rows.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type)
            for f, c in ((f, columns[f.name]) for f in schema)
        ],
        schema=schema,
    )


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; null is the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts of a batch as UTF-8; null is the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
