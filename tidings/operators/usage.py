"""Use after signing up: activation within some days, by cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_number(at: Column) -> Column:
    return F.unix_date(at.cast("date"))


def first_signups(signups: DataFrame) -> DataFrame:
    """user_id and the day number of the first signup; ``signups`` has user_id and at."""
    known = signups.filter(F.col("user_id").isNotNull() & F.col("at").isNotNull())
    return known.groupBy("user_id").agg(F.min(day_number(F.col("at"))).alias("joined"))


def active_days(signups: DataFrame, actions: DataFrame, days: int) -> DataFrame:
    """user_id, joined, and each day, counted from the signup, below ``days`` with an action.

    ``actions`` has user_id and at. Actions become days of users before the shuffle, so a user with
    very many is as many rows as days. The interval is joined by bins of its length: a signup falls
    into its bin and the next, an action into its own, and only users' bins that meet are compared.
    """
    joined = first_signups(signups)
    bins = joined.withColumn("bin", F.floor(F.col("joined") / days)).withColumn(
        "bin", F.explode(F.array("bin", F.col("bin") + 1))
    )
    acted = actions.filter(F.col("at").isNotNull()).select("user_id", day_number(F.col("at")).alias("day")).distinct()
    acted = acted.withColumn("bin", F.floor(F.col("day") / days))
    after = F.col("day") - F.col("joined")
    met = bins.join(acted, ["user_id", "bin"]).filter((after >= 0) & (after < days))
    return met.select("user_id", "joined", after.alias("after"))


def activation_rates(signups: DataFrame, actions: DataFrame, days: int, cohort_days: int = 7) -> DataFrame:
    """Per cohort (signups of ``cohort_days`` days) and day after the signup: users, how many had acted
    by that day, and the share. The last day of a cohort has its activation rate.
    """
    first = F.col("joined") - F.pmod("joined", F.lit(cohort_days))
    cohort = F.date_from_unix_date(first.cast("int")).alias("cohort")
    sizes = first_signups(signups).groupBy(cohort).agg(F.count("*").alias("users"))
    began = active_days(signups, actions, days).groupBy("user_id", "joined").agg(F.min("after").alias("after"))
    counts = began.groupBy(cohort, "after").agg(F.count("*").alias("n"))
    # A small matrix from here on: cohorts times days.
    matrix = sizes.withColumn("within", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    reached = matrix.join(
        counts.withColumnRenamed("cohort", "of"),
        (F.col("cohort") == F.col("of")) & (F.col("after") <= F.col("within")),
        "left",
    )
    acted = F.coalesce(F.sum("n"), F.lit(0))
    return reached.groupBy("cohort", "within", "users").agg(acted.alias("activated")).withColumn(
        "rate", F.round(F.col("activated") / F.col("users"), 6)
    )
