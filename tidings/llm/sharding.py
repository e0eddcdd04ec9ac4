"""Sharding by a two-pass external shuffle, with DataFrame operations alone.

The first pass scatters the records uniformly, by a seeded hash, into buckets that fit in memory, and
writes the buckets. The second reads them, draws a random order within each (``shuffle`` is the
Fisher-Yates algorithm) and deals the records out: the prefix sum of the buckets before a record's
own, plus its place in it, gives its place in the corpus; that place modulo the number of shards
gives its shard. So shard sizes in rows differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.catalog import query, table
from tidings.session import staged

SHARDS = 8
SEED = 20260101
#: What a bucket should hold at most; the hash keeps buckets near their mean.
BUCKET_BYTES = 16 << 20


def sharded(
    records: DataFrame, weight: Column, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """``record`` (a struct of all columns of the input), shard and slot, for every record.

    ``weight`` is the size of a record in bytes. Any columns, names, nulls and repeated rows pass
    through unchanged within ``record``; repeated rows scatter like others, since the hash takes
    the number of a row in the scattered table along. An empty table gives no rows. The order
    depends on the seed and on how the input is split, and holds when a task is repeated.
    """
    spark = records.sparkSession
    held = staged(
        records.select(
            F.struct(*(F.col(f"`{c}`") for c in records.columns)).alias("record"),
            weight.cast("long").alias("weight"),
            F.monotonically_increasing_id().alias("row"),
        ),
        compression="zstd",
    )
    total = held.agg(F.sum("weight")).first()[0] or 0
    least = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-total // BUCKET_BYTES))
    scattered = held.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(buckets)).cast("int")
    )
    # First pass: a row per bucket, its records in a fixed order. Buckets are made where their records
    # meet, in tasks that hold few of them, so no task gathers records of all buckets on the way.
    tasks = -(-buckets // 4)
    filled = staged(
        scattered.repartition(tasks, "bucket").groupBy("bucket").agg(
            F.count("*").alias("n"),
            F.sort_array(F.collect_list(F.struct("row", "record"))).alias("items"),
        ),
        compression="zstd",
    )
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Staged, so that its size is known to be small and the records need no second exchange.
    bases = staged(
        filled.select(
            F.col("bucket").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
        )
    )
    # Second pass: a random order within each bucket, then places in the corpus.
    drawn = filled.select("bucket", F.shuffle("items", seed).alias("items"))
    placed = drawn.select("bucket", F.posexplode("items").alias("at", "item"))
    place = F.col("base") + F.col("at")
    return placed.join(bases, F.col("bucket") == F.col("of")).select(
        "item.record",
        (place % shards).cast("int").alias("shard"),
        F.floor(place / shards).cast("long").alias("slot"),
    )


def write_shards(records: DataFrame, weight: Column, folder: str, shards: int = SHARDS) -> None:
    """Write the records as one directory per shard, in slot order within a file."""
    out = sharded(records, weight, shards)
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = out.repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(folder)


@query("op10_two_pass_shuffle")
def op10_two_pass_shuffle(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    documents = table(spark, sf_dir, "documents")
    of = F.coalesce("record.text", F.lit(""))
    return sharded(documents, F.octet_length(text) + 1).select(
        "record.doc_id",
        (F.octet_length(of) + 1).cast("long").alias("size"),
        F.crc32(F.encode(of, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
