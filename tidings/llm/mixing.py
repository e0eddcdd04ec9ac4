"""Mixing sources to target weights: repetition rates from totals, then hash-seeded copies.

Sizes are summed per source; weights give each source a target, bounded by a multiple of its size;
target over size is the rate at which the source repeats. A document is emitted floor(rate) times,
and once more if its own coin, a hash, falls below the fraction that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidings.llm.catalog import query, table
from tidings.session import staged

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: Size of the mix, and of the share of one source at most, as multiples of what there is.
SHARE, MOST = 1.5, 2.0
SEED = 20260301
#: Hexadecimal digits of a hash that make a coin: as many bits as a double holds exactly.
DIGITS = 13


def n_words(text: Column) -> Column:
    """Number of runs of anything but space and the controls 0x09 to 0x0D; null has none.

    Every word, with the space before it, becomes one character; space at the end goes.
    """
    space = r"\x20\x09-\x0D"
    ones = F.regexp_replace(text, rf"[{space}]*+[^{space}]++", ".")
    return F.coalesce(F.length(F.regexp_replace(ones, rf"[{space}]++", "")), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``totals`` (source, source_size; one row per source) with target and rate.

    Sources in code-point order, null last, take ``weights`` in turn. Each gets the least of
    ``most`` times its size and weight times level. The level that spends ``share`` of all sizes is
    reached where the sources that fill up first have been taken out; up to there the level left to
    the others rises, from there on it falls, so it is the greatest of them. A source of size 0 has
    target and rate 0; no sources give no rows.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    # One row per source: these windows hold no documents.
    fuller = Window.orderBy("fills", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = totals.withColumn("place", F.row_number().over(by_name) - 1)
    weighed = ranked.select(
        "source",
        "source_size",
        "place",
        F.element_at(
            F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")
        ).alias("weight"),
    ).withColumn("limit", F.col("source_size") * F.lit(most))
    filled = weighed.withColumn("fills", F.col("limit") / F.col("weight"))
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(
        F.sum("limit").over(fuller), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(fuller), F.lit(0.0))
    levelled = filled.withColumn("level", left / open_weight)
    aimed = levelled.withColumn(
        "target", F.least("limit", F.col("weight") * F.max("level").over(everything))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return aimed.select("source", "source_size", "target", rate.alias("rate"))


def coin(key: Column) -> Column:
    """A number from 0 up to 1 that a key's hash gives."""
    drawn = F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double")
    return drawn / F.lit(float(16**DIGITS))


def repeat_numbers(rows: DataFrame) -> DataFrame:
    """``row`` and its number among the rows of its ``key``, from 0, for keys of several rows.

    Rows are numbered within the input split they come from, then the splits' counts are summed up
    before each other: a key that a third of all rows share is numbered by as many tasks as it has
    splits. A row's split is the upper part of its mark.
    """
    several = rows.groupBy("key").count().filter("count > 1").select("key")
    shared = rows.select("key", "row").join(several, "key", "left_semi")
    shared = shared.withColumn("split", F.shiftright("row", 33))
    counts = shared.groupBy("key", "split").count()
    earlier = Window.partitionBy("key").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("key", "split", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("key", "split").orderBy("row")) - 1
    numbered = shared.withColumn("within", within).join(bases, ["key", "split"])
    return numbered.select("row", (F.col("base") + F.col("within")).alias("number"))


def planned(
    docs: DataFrame,
    size: Column,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = SEED,
) -> DataFrame:
    """``record`` (a struct of all columns), size, source_size, target and copies of every document.

    ``docs`` has doc_id, source and text, of which any may be null; ``size`` is an expression on
    them. A coin hangs on id, source and text, and for rows that repeat all three on a number among
    them, so equal rows have coins of their own, and how the input is split changes no count. Other
    columns pass through within ``record``; an empty table gives no rows.
    """
    key = F.md5(
        F.concat_ws(
            ":",
            F.lit(str(seed)),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
            F.md5(F.coalesce("text", F.lit(""))),
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")),
        )
    )
    # Staged: sizes are taken once, and the marks of rows stay.
    held = staged(
        docs.select(
            F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"),
            F.col("source"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
            key.alias("key"),
            F.monotonically_increasing_id().alias("row"),
        ),
        compression="zstd",
    )
    totals = held.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Staged, so that its size is known when Spark chooses the join with the documents.
    rates = staged(targets(totals, weights, share, most)).withColumnRenamed("source", "of")
    rated = held.join(rates, F.col("source").eqNullSafe(F.col("of")))
    numbered = rated.join(repeat_numbers(held), "row", "left")
    whole = F.floor("rate")
    drawn = coin(F.concat_ws(":", "key", F.coalesce("number", F.lit(0)).cast("string")))
    more = (drawn < F.col("rate") - whole).cast("long")
    return numbered.select("record", "size", "source_size", "target", (whole + more).alias("copies"))


def mixed(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix: the columns of ``docs``, each document as often as ``planned`` says."""
    plan = planned(docs, size, **options).filter("copies > 0")
    return plan.select("record", F.explode(F.sequence(F.lit(1), "copies"))).select("record.*")


_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, {_WORDS} AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':'
        || coalesce('s' || source, '')) AS key
  FROM documents
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY key) - 1 AS number FROM sized
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{", ".join(f"{w}::DOUBLE" for w in WEIGHTS)}][place % {len(WEIGHTS)} + 1] AS weight,
    source_size * {MOST}::DOUBLE AS most
  FROM ranked
), levelled AS (
  SELECT *, (sum(source_size) OVER () * {SHARE}::DOUBLE
      - coalesce(sum(most) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))
    AS level
  FROM weighed
  WINDOW before AS (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM (
    SELECT source, source_size, least(most, weight * max(level) OVER ()) AS target FROM levelled
  )
)
SELECT doc_id, size, r.source_size, r.target, size * (floor(rate)::BIGINT + (
    ('0x' || substr(md5(key || ':' || number), 1, {DIGITS}))::BIGINT / {16**DIGITS}::DOUBLE
      < rate - floor(rate))::BIGINT) AS taken
FROM numbered n JOIN rates r ON n.source IS NOT DISTINCT FROM r.source
"""


@query("op11_target_mixing", SQL)
def op11_target_mixing(spark, sf_dir):
    plan = planned(table(spark, sf_dir, "documents"), n_words(F.col("text")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return plan.select("record.doc_id", "size", "source_size", "target", taken)
