"""The training-data pipeline: quality, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's ``docs``. All but the last return the columns of ``docs``, whatever others it has.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidings.llm import chunk_dedup, jaccard_join, nb_svm, packing, personal_data
from tidings.llm.catalog import prepared, raw_texts, table, unused
from tidings.session import staged


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, fitted on their labels."""
    prepared(spark)
    model = nb_svm.fitted(docs, table(spark, sf_dir, "labels"))
    held = spark.sparkContext.broadcast(model)  # fixed size

    def run(batches):
        for batch in batches:
            kept = [held.value.score(t) >= nb_svm.THRESHOLD for t in raw_texts(batch)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate class, repeated rows included: that of least doc_id."""
    prepared(spark)
    mark = unused(docs, "mark")
    # Staged, so that the marks stay.
    held = staged(docs.withColumn(mark, F.monotonically_increasing_id()), compression="zstd")
    rows = held.select("doc_id", "text", F.col(mark).alias("mark"))
    first = jaccard_join.first_rows(rows).withColumnRenamed("mark", mark)
    return held.join(first, mark, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds; a text left without a word goes."""
    prepared(spark)

    @pandas_udf("string")
    def left(text: pd.Series, elsewhere: pd.Series) -> pd.Series:
        shorter = (
            chunk_dedup.shortened((t or "").encode("utf-8", "replace"), e)[2].decode()
            for t, e in zip(text, elsewhere)
        )
        return pd.Series(list(shorter), dtype=object)

    elsewhere, new = unused(docs, "elsewhere"), unused(docs, "left")
    found = chunk_dedup.found_elsewhere(docs, elsewhere)
    changed = found.withColumn(new, left("text", elsewhere)).filter(F.col(new).rlike(r"\S"))
    return _with_text(docs, changed, new)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark of its kind in place of every email, address, card and phone number."""
    prepared(spark)

    @pandas_udf("string")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([personal_data.clean(t or "") for t in text], dtype=object)

    new = unused(docs, "clean")
    return _with_text(docs, docs.withColumn(new, clean("text")), new)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences, with their ids."""
    return packing.packed(prepared(spark) and docs)


def _with_text(docs: DataFrame, changed: DataFrame, column: str) -> DataFrame:
    """The columns of ``docs``, with the text in ``column`` of ``changed`` and its length."""
    new = {"text": F.col(column)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(column).cast(docs.schema["n_chars"].dataType)
    return changed.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_near_duplicates),
    ("substring dedup", without_repeated_passages),
    ("PII", without_personal_data),
    ("packing", packed_sequences),
]

#: Trained weights, signatures and a tokenizer are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepared(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
