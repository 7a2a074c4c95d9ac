"""History of changing attributes from periodic snapshots, by presence bitmaps.

For each entity and attribute the days on which the attribute was delivered are numbered in order. Each value (by its
hash) sets one bit per delivered day; a run of consecutive bits is a stretch in which the value held. Days on which
the attribute was not delivered have no number, so they never break a run. Bits are gathered in 64-bit words, one row
per (entity, attribute, value, word), by a plain ``bit_or`` aggregation with map-side combine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31"


def picture_key(url: Column) -> Column:
    """Address of the picture file: no scheme, host in lower case, no query, no fragment; empty is null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"^(?:[hH][tT][tT][pP][sS]?:)?//(?:www\.)?", "")
    host = F.lower(F.substring_index(bare, "/", 1))
    return F.nullif(F.concat(host, F.substring(bare, F.length(host) + 1, F.length(bare))), F.lit(""))


def cents(price: Column) -> Column:
    """Price in whole hundredths, so that inexact doubles of one price are equal."""
    return F.round(price * 100).cast("long")


def daily_state(df: DataFrame, entity: str, at: str, order: str, attributes: dict[str, Column]) -> DataFrame:
    """One row (entity, day, attributes) per entity and day: of each attribute what the day's latest row delivered.

    A null means not delivered, so an earlier value of the same day stands; rows of one moment are ordered by ``order``.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).select(
        F.col(entity).alias("entity"), F.to_date(at).alias("day"), F.struct(F.col(at).alias("t"), F.col(order).alias("o")).alias("_at"), *[c.cast("string").alias(k) for k, c in attributes.items()]
    )
    return rows.groupBy("entity", "day").agg(*[F.expr(f"max_by(`{k}`, _at) FILTER (WHERE `{k}` IS NOT NULL)").alias(k) for k in attributes])


def attribute_runs(daily: DataFrame, attributes: list[str]) -> DataFrame:
    """Rows (entity, attribute, value, day): the first day of each run in which the attribute kept one value."""
    long = daily.select("entity", "day", F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.col(k).alias("v")) for i, k in enumerate(attributes)])).alias("x")).select("entity", "day", "x.a", "x.v").where("v IS NOT NULL")
    w = Window.partitionBy("entity", "a").orderBy("day")
    numbered = long.withColumn("n", F.row_number().over(w) - 1)
    words = numbered.groupBy("entity", "a", F.xxhash64("v").alias("h"), F.floor(F.col("n") / 64).cast("int").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, n % 64))").alias("bits"),
        F.min("v").alias("v"),
        # the day of each bit rides along, so that no join is needed to find it again; at most 64 entries
        F.expr("map_from_entries(collect_list(struct(cast(n % 64 as int), day)))").alias("days"),
    )
    before = Window.partitionBy("entity", "a", "h").orderBy("word")
    carry = F.when(F.lag("word").over(before) == F.col("word") - 1, F.expr("shiftrightunsigned(lag(bits) OVER (PARTITION BY entity, a, h ORDER BY word), 63)")).otherwise(F.lit(0).cast("long"))
    starts = words.withColumn("carry", carry).withColumn("s", F.expr("bits & ~(shiftleft(bits, 1) | carry)"))
    bit = F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(s, b) & 1L) = 1L)"))
    return starts.select("entity", "a", "v", "days", bit.alias("b")).select("entity", F.element_at(F.array(*[F.lit(k) for k in attributes]), F.col("a") + 1).alias("attribute"), F.col("v").alias("value"), F.expr("try_element_at(days, b)").alias("day"))


def version_history(df: DataFrame, entity: str = "product_id", at: str = "generated_at", order: str = "snap_id", attributes: dict[str, Column] | None = None) -> DataFrame:
    """One row per version of the attributes together: entity, attributes, ``version_from`` and ``version_until`` (DATE).

    A version starts on the entity's first day and on each day on which the state differs from the state before;
    a value returns as a new version. ``version_until`` is the day before the next version, 9999-12-31 for the last.
    Attributes are compared by the given columns (cast to string). A null attribute was not delivered: the value known
    before still holds, and before the first delivery the state is null. Late arrivals, copies and several runs a day
    are put in order by ``at`` and ``order``. Rows without entity or moment are ignored; an empty table gives no rows.
    """
    attributes = attributes if attributes is not None else {"new_price": cents(F.col("new_price")), "health_score": F.col("health_score"), "image": picture_key(F.col("image"))}
    names = list(attributes)
    daily = daily_state(df, entity, at, order, attributes)
    runs = attribute_runs(daily, names)
    first = daily.groupBy("entity").agg(F.min("day").alias("day")).select("entity", F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("value"), "day")
    starts = runs.unionByName(first).groupBy("entity", "day").agg(*[F.max(F.when(F.col("attribute") == k, F.col("value"))).alias(k) for k in names])
    w = Window.partitionBy("entity").orderBy("day")
    return starts.select(
        F.col("entity").alias(entity),
        *[F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in names],
        F.col("day").alias("version_from"),
        F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.to_date(F.lit(FOREVER))).alias("version_until"),
    )
