"""When a notice was listed: validity intervals from the listings of its source.

A notice is there from the day a listing shows it. It is gone on the first day after that on which
a complete listing of its source does not show it; listings that are known to be incomplete say
nothing about what they lack. A notice that is listed again has a further interval.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SOURCE, KEY, DAY = "source_code", "external_id", "day"
INTERVALS = "source_code string, external_id string, valid_from date, valid_to date"


def listing_numbers(listings: DataFrame) -> DataFrame:
    """source_code, day, and how many complete listings the source had before and up to the day.

    ``listings`` has source_code, day and complete. Of several listings on a day one complete one is
    enough. One row per source and day: the window holds the days of a source.
    """
    days = listings.groupBy(SOURCE, DAY).agg(F.max("complete").cast("int").alias("full"))
    upto = F.sum("full").over(Window.partitionBy(SOURCE).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("full"))


def notice_history(sightings: DataFrame, listings: DataFrame) -> DataFrame:
    """source_code, external_id, valid_from and valid_to (null: still there) of every interval.

    ``sightings`` has source_code, external_id and day, repeated or not; every day of it has a row in
    ``listings``. Complete listings are numbered, so whether one came between two sightings is a
    difference of numbers, and only the day on which an interval ends is looked up: no notice meets
    all listings of its source.
    """
    numbered = listing_numbers(listings)
    seen = sightings.select(SOURCE, KEY, DAY).distinct().join(numbered.drop("full"), [SOURCE, DAY])
    by_day = Window.partitionBy(SOURCE, KEY).orderBy(DAY)
    # A complete listing without the notice lies between this sighting and the one before.
    fresh = F.coalesce(F.col("before") > F.lag("upto").over(by_day), F.lit(True))
    island = F.sum(F.when(fresh, 1).otherwise(0)).over(by_day)
    spans = seen.withColumn("island", island).groupBy(SOURCE, KEY, "island").agg(
        F.min(DAY).alias("valid_from"), F.max("upto").alias("last")
    )
    ends = numbered.filter("full = 1").select(SOURCE, (F.col("upto") - 1).alias("last"), F.col(DAY).alias("valid_to"))
    return spans.join(ends, [SOURCE, "last"], "left").select(SOURCE, KEY, "valid_from", "valid_to")


def advance(history: DataFrame, sightings: DataFrame, listings: DataFrame, day) -> DataFrame:
    """The history after the listings of one more day, later than all before."""
    day = F.lit(day).cast("date")
    on_day = lambda rows: rows.filter(F.col(DAY) == day)
    seen = on_day(sightings).select(SOURCE, KEY).distinct()
    full = on_day(listings).filter("complete").select(SOURCE).distinct()
    open_, closed = history.filter("valid_to IS NULL"), history.filter("valid_to IS NOT NULL")
    stays = open_.join(seen, [SOURCE, KEY], "left_semi")
    unseen = open_.join(seen, [SOURCE, KEY], "left_anti")
    ended = unseen.join(full, SOURCE, "left_semi").withColumn("valid_to", day)
    unknown = unseen.join(full, SOURCE, "left_anti")
    new = seen.join(open_.select(SOURCE, KEY), [SOURCE, KEY], "left_anti").select(
        SOURCE, KEY, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to")
    )
    parts = (closed, stays, ended, unknown, new)
    columns = (SOURCE, KEY, "valid_from", "valid_to")
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def valid_on(day) -> Column:
    """Condition on intervals: what was there on a day."""
    day = F.lit(day).cast("date")
    return (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") > day))
