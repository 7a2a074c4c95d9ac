"""Ranked reports: shares of the best, pages, comparisons of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.operators.dedupe import keep_best


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, with ``place``; only these rows reach the one task that numbers them."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(w))


def unique_top(df: DataFrame, key: str, order: Sequence[Column], n: int, least: int = 1) -> DataFrame:
    """The best row of each of the first ``n`` keys in ``order``, with ``place``; none if there are fewer than ``least``.

    The best row of a key is kept first, on the map side where it can be; rows without a key are left out.
    """
    best = keep_best(df.where(F.col(key).isNotNull()), [key], order)
    ranked = top(best, order, n)
    return ranked if least <= 1 else ranked.withColumn("_n", F.count("*").over(Window.partitionBy())).where(F.col("_n") >= least).drop("_n")


def share_of_best(ranked: DataFrame, value: str) -> DataFrame:
    """A top report with ``bar``: the value in whole percent of the best."""
    return ranked.withColumn("bar", F.floor(F.col(value) / F.max(value).over(Window.partitionBy()) * 100 + 0.5).cast("int"))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 36) -> DataFrame:
    """Page ``number`` (from 1) of the rows in ``order``; a number beyond the last page gives the last one.

    Nothing is counted beforehand: the rows up to the page's end are taken, and where they are fewer, their last page is
    the last one.
    """
    number = max(1, number)
    w = Window.orderBy(*order)
    rows = df.orderBy(*order).limit(number * size).withColumn("_page", F.floor((F.row_number().over(w) - 1) / size) + 1)
    return rows.withColumn("_last", F.max("_page").over(Window.partitionBy())).where(F.col("_page") == F.least(F.lit(number), F.col("_last"))).drop("_page", "_last").orderBy(*order)


def page_of(df: DataFrame, order: Sequence[Column], row: Column, size: int = 36) -> DataFrame:
    """``number``: the page on which the rows that satisfy ``row`` stand.

    Instead of numbering all rows in one task, the rows before the wanted ones are counted.
    """
    sort_key = F.struct(*order)
    wanted = df.where(row).select(sort_key.alias("_w"))
    at = df.select(sort_key.alias("_k")).join(F.broadcast(wanted.limit(1)), F.col("_k") < F.col("_w")).agg(F.count("*").alias("n"))
    return at.select((F.floor(F.col("n") / size) + 1).cast("bigint").alias("number"))


def page_links(current: int, pages: int, around: int = 2) -> list[int]:
    """Numbers of the pages around the current one."""
    return list(range(max(1, current - around), min(pages, current + around) + 1))


def compare_groups(best: DataFrame, key: str, member: str, value: str, quality: str, n: int = 12) -> DataFrame:
    """Comparison of the members of each key, from one row per (key, member).

    ``lowest``, ``second`` and ``highest`` values, the lowest one's member, the saving against the second, the best
    quality and the number of members; keys with at least two members and a saving; the ``n`` best by quality, members,
    saving (falling), lowest value and key. The lists are as long as a key has members.
    """
    groups = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(value).alias("v"), F.col(member).alias("m")))).alias("_l"), F.max(quality).alias("best_quality"))
    at = lambda i: F.try_element_at("_l", F.lit(i))
    out = groups.where(F.size("_l") > 1).select(
        key, at(1)["m"].alias("best_member"), at(1)["v"].alias("lowest"), at(2)["v"].alias("second"), at(-1)["v"].alias("highest"),
        F.greatest(at(2)["v"] - at(1)["v"], F.lit(0)).alias("saving"), "best_quality", F.size("_l").cast("bigint").alias("members"),
    )
    out = out.where((F.col("highest") > F.col("lowest")) & (F.col("saving") > 0))
    return out.orderBy(F.desc("best_quality"), F.desc("members"), F.desc("saving"), "lowest", key).limit(n)
