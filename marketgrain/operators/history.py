"""Change logs, their retention, statistics and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.operators.dedupe import keep_best


def change_log(df: DataFrame, key: str, at: str, value: str, order: str) -> DataFrame:
    """One row per change of ``value``: of each day its first row, kept if it differs from the day kept before.

    Rows without a value are no observations. ``order`` breaks ties of a moment.
    """
    daily = keep_best(df.where(F.col(value).isNotNull()).withColumn("_day", F.to_date(at)), [key, "_day"], [F.col(at), F.col(order)])
    w = Window.partitionBy(key).orderBy("_day")
    before = F.lag(value).over(w)
    return daily.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") != F.col(value))).drop("_before").withColumnRenamed("_day", "day")


def retain_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in ``order`` (newest first for a retention)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def log_statistics(log: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Per key: entries, lowest value with its first day, mean over the entries, first and last day."""
    return log.groupBy(key).agg(
        F.count("*").alias("entries"), F.min(value).alias("lowest"), F.min_by(day, F.struct(value, day)).alias("lowest_day"), F.avg(value).alias("mean"), F.min(day).alias("first_day"), F.max(day).alias("last_day")
    )


def trend(log: DataFrame, key: str, day: str, value: str, band: float = 2.0) -> DataFrame:
    """Per key: the last two values, the change in percent and ``up``, ``down`` or ``flat`` (within ``band`` percent).

    Keys with fewer than two values, or a previous value of 0, are left out.
    """
    w = Window.partitionBy(key).orderBy(F.desc(day))
    last_two = log.where(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    pair = last_two.groupBy(key).agg(F.max(F.when(F.col("_n") == 1, F.col(value))).alias("last"), F.max(F.when(F.col("_n") == 2, F.col(value))).alias("previous"))
    pct = (F.col("last") - F.col("previous")) / F.col("previous") * 100
    return pair.where(F.col("previous").isNotNull() & (F.col("previous") != 0)).withColumn("pct", pct).withColumn("direction", F.when(F.col("pct") > band, "up").when(F.col("pct") < -band, "down").otherwise("flat"))


def scaled(log: DataFrame, key: str, day: str, value: str, height: int = 14, base: int = 2, least_range: float = 1.0) -> DataFrame:
    """Entries with ``bar``: the value scaled between the key's lowest and highest to ``base`` … ``base + height``."""
    w = Window.partitionBy(key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    spread = F.when(high == low, F.lit(least_range)).otherwise(high - low)
    step = Window.partitionBy(key).orderBy(day)
    move = F.when(F.lag(value).over(step).isNull() | (F.lag(value).over(step) == F.col(value)), "flat").when(F.col(value) > F.lag(value).over(step), "up").otherwise("down")
    return log.withColumn("bar", (F.floor((F.col(value) - low) / spread * height + 0.5) + base).cast("int")).withColumn("move", move)


def badges(current: DataFrame, stats: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with ``badge``: ``lowest`` (of two entries or more), ``above_average`` (by over 5 %), else ``tracking``."""
    joined = current.join(stats.select(key, "entries", "lowest", "mean"), key, "left")
    badge = F.when((F.col("entries") >= 2) & (F.col(value) <= F.col("lowest")), "lowest").when(F.col(value) > F.col("mean") * 1.05, "above_average").otherwise("tracking")
    return joined.withColumn("badge", badge)
