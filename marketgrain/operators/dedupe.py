"""Keeping one row per key, and merging rows of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.session import cut, shuffle_width


def keep_best(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``; null keys are a key of their own.

    Spark keeps the first row of each key on either side of the exchange (WindowGroupLimit), so a hot key sends one row
    per task. The order should end in a unique column, else ties are broken at will.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def merge_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], members: dict[str, Column]) -> DataFrame:
    """The best row of each key with sorted lists of what its rows hold.

    ``members`` names array columns: a struct or value per row, gathered distinct and sorted. The lists are gathered
    from the rows that the caller has brought to one per key and member, so they are as long as a key has members.
    """
    best = keep_best(df, keys, order)
    lists = df.groupBy(*keys).agg(F.count("*").alias("members"), *[F.array_sort(F.collect_set(c)).alias(n) for n, c in members.items()])
    for k in keys:
        lists = lists.withColumnRenamed(k, f"_{k}")
    return best.join(lists, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def add_unseen(base: DataFrame, more: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` and the rows of ``more`` whose key ``base`` does not have (null keys never match)."""
    return base.unionByName(more.join(base.select(*key).distinct(), list(key), "left_anti"), allowMissingColumns=True)


def union_first(parts: Sequence[DataFrame], keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of the parts with one row per key: of the earliest part, there the first in ``order``."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    rows = tagged[0]
    for p in tagged[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return keep_best(rows, keys, [F.col("_part"), *[F.col(c) for c in order]]).drop("_part")


def take_unique(df: DataFrame, key: Column, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` of which no two share ``key``."""
    return keep_best(df.withColumn("_key", key), ["_key"], order).orderBy(*order).limit(n).drop("_key")


def promo_first(df: DataFrame, code: str, is_promo: Column, price: str, order: str) -> DataFrame:
    """One row per product code: the first promotion if there is one, else the cheapest row (first of equals).

    Rows without a code are all kept.
    """
    coded = keep_best(df.where(F.col(code).isNotNull()), [code], [F.desc(is_promo), F.when(~is_promo, F.col(price)).asc_nulls_last(), F.col(order)])
    return df.where(F.col(code).isNull()).unionByName(coded)


def numbered_ids(df: DataFrame, base: str, order: Sequence[Column], out: str) -> DataFrame:
    """``out``: the base id, with -2, -3, … for the further rows of one base in ``order``.

    Rows are range-partitioned by base and order and numbered within their partition; what stands before comes from the
    counts of base and partition, so a hot base is spread over many tasks. Rows of equal order stay together.
    """
    spread = cut(df.repartitionByRange(shuffle_width(df.sparkSession), F.col(base), *order).withColumn("_p", F.spark_partition_id()))
    counts = spread.groupBy(F.col(base).alias("_base"), F.col("_p").alias("_part")).agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_base").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_base", "_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    rows = spread.withColumn("_n", F.row_number().over(Window.partitionBy(base, "_p").orderBy(*order)))
    rows = rows.join(counts, rows[base].eqNullSafe(counts["_base"]) & (rows["_p"] == counts["_part"]))
    n = F.col("_n") + F.col("_before")
    return rows.withColumn(out, F.when(n == 1, F.col(base)).otherwise(F.concat_ws("-", F.col(base), n.cast("string")))).drop("_p", "_n", "_base", "_part", "_before")
