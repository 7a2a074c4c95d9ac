"""Structured Streaming forms of the stateful parts. Event times are TIMESTAMP (cast from zone-less ones in UTC)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def parquet_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """Stream of a growing folder of Parquet files, ``files`` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def change_stream(stream: DataFrame, key: str, at: str, value: str, keep: int = 104) -> DataFrame:
    """Changes of ``value`` per key, with the state folded over the stream: (key, day, value, entries).

    An entry is made when the value is given, the day is later than the last entry's day and the value differs from it,
    so a replayed batch makes none. The state is the last entry and the number of entries, at most ``keep``; its size
    does not grow with the stream. Rows of a batch are taken in order of time. Late days are ignored.
    """
    key_type, value_type = stream.schema[key].dataType.simpleString(), stream.schema[value].dataType.simpleString()
    out = f"{key} {key_type}, day date, {value} {value_type}, entries int"
    state_type = f"day date, value {value_type}, entries int"

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True).dropna(subset=[value]).sort_values(at, kind="stable")
        last_day, last, entries = state.get if state.exists else (None, None, 0)
        made = []
        for moment, v in zip(rows[at], rows[value], strict=True):
            day = moment.date()
            if last_day is None or (day > last_day and v != last):
                last_day, last, entries = day, v, min(keep, entries + 1)
                made.append((k[0], day, v, entries))
        if last_day is not None:
            state.update((last_day, last, entries))
        yield pd.DataFrame(made, columns=[key, "day", value, "entries"])

    return stream.groupBy(key).applyInPandasWithState(fold, out, state_type, "append", GroupStateTimeout.NoTimeout)


def daily_counts(stream: DataFrame, at: str, by: str, late: str = "2 days") -> DataFrame:
    """Counts per UTC day and ``by``, in tumbling windows with a watermark of ``late``."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, "1 day").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("day"), by, "n")


def weekly_counts(stream: DataFrame, at: str, by: str, late: str = "7 days") -> DataFrame:
    """Counts per week (from Monday, UTC) and ``by``, with a watermark."""
    rows = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    # windows are counted from 1970-01-01, a Thursday; Mondays are four days later
    return rows.groupBy(F.window(at, "7 days", startTime="4 days").alias("w"), by).agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("week"), by, "n")


def upsert_counters(root: str, key: str, member: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that adds counts and member sets of each batch to a versioned table under ``root``.

    Every batch writes its own version from the one before, so a batch that is run again writes the same version anew.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_set(member)).alias("members"))
        if number > 0:
            old = spark.read.parquet(f"{root}/batch={number - 1}")
            new = old.unionByName(new).groupBy(key).agg(F.sum("n").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members"))
        new.write.mode("overwrite").parquet(f"{root}/batch={number}")

    return step


def run_log(root: str, keep: int = 50) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that keeps a log of the last ``keep`` batches: number, rows, first and last moment."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        entry = batch.agg(F.lit(number).cast("bigint").alias("batch"), F.count("*").alias("rows"))
        if number > 0:
            entry = spark.read.parquet(f"{root}/run={number - 1}").where(F.col("batch") > number - keep).unionByName(entry)
        entry.coalesce(1).write.mode("overwrite").parquet(f"{root}/run={number}")

    return step


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into Parquet at ``path`` and stop."""
    df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def batches_to_end(df: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Give all that is there to a batch step and stop."""
    df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
