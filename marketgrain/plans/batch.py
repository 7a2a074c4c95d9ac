"""One run of the offer pipeline: union of sources, dedupe, merge across stores, upsert, history, publishing.

Every step is a DataFrame plan; the run reads the stored version, writes new versions and never changes old ones, so a
run that failed can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.functions.scalars import short_id, slug
from marketgrain.operators import dedupe, history, joins
from marketgrain.sources import sinks


@dataclass
class Run:
    """What a run has published: paths of the offers, the products and their change log."""

    offers: str
    products: str
    log: str


def gather(sources: Sequence[DataFrame]) -> DataFrame:
    """Union of the sources by name; ``ord`` tells source and place, so that ties go to the earlier source."""
    parts = [s.withColumn("_source", F.lit(i)) for i, s in enumerate(sources)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.withColumn("ord", F.struct("_source", "ord")).drop("_source")


def one_per_store(rows: DataFrame, priority: dict[str, int], facts: Sequence[str] = ("old_price", "valid_until", "weight_raw", "image")) -> DataFrame:
    """The best row of each name and store: by the source's priority (2 if not named), number of ``facts``, arrival."""
    rank = F.lit(2)
    for name, p in priority.items():
        rank = F.when(F.col("source") == name, F.lit(p)).otherwise(rank)
    known = sum((F.col(c).isNotNull().cast("int") for c in facts if c in rows.columns), F.lit(0))
    rows = rows.withColumns({"_key": F.lower(F.trim("name")), "_prio": rank})
    return dedupe.keep_best(rows, ["_key", "store"], [F.desc("_prio"), known.desc(), F.col("ord")])


def across_stores(best: DataFrame) -> DataFrame:
    """One row per name with the stores that have it and their prices, cheapest first."""
    merged = dedupe.merge_groups(best, ["_key"], [F.desc("_prio"), F.col("new_price").asc_nulls_last(), F.col("ord")], {"available_stores": F.col("store"), "store_prices": F.struct(F.col("new_price").isNull().alias("unknown"), F.col("new_price").alias("price"), "store")})
    cheapest = F.try_element_at("store_prices", F.lit(1))
    return merged.withColumns({"best_price": cheapest["price"], "best_price_store": cheapest["store"]}).withColumnRenamed("members", "comparison_count")


def with_product_id(rows: DataFrame) -> DataFrame:
    """``product_id`` of store and name; the ending keeps cut names apart."""
    return rows.withColumn("product_id", F.concat_ws("-", slug(F.col("store"), 20), slug(F.col("name"), 50), short_id(F.col("store"), F.col("_key"))))


def run(spark: SparkSession, sources: Sequence[DataFrame], root: str, day: str, priority: dict[str, int] | None = None, keep: int = 104) -> Run:
    """Publish the offers of a day; an empty result is an error and publishes nothing new of products and log."""
    offers = with_product_id(across_stores(one_per_store(gather(sources), priority or {})))
    current = offers.select("product_id", "name", "_key", "store", F.col("new_price").alias("price"), F.to_date(F.lit(day)).alias("last_seen"), F.to_date(F.lit(day)).alias("first_seen"))
    out = Run(f"{root}/offers", f"{root}/products", f"{root}/log")
    path = sinks.write_version(offers.drop("ord", "_prio"), out.offers, day)
    current = current.join(spark.read.parquet(path).select("product_id"), "product_id", "left_semi")
    new_log = current.where("price IS NOT NULL").select("product_id", F.col("last_seen").alias("day"), "price")
    try:
        stored, log = sinks.latest_version(spark, out.products).drop("version"), sinks.latest_version(spark, out.log).drop("version")
    except Exception as missing:  # no earlier run
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        stored, log = None, None
    if stored is not None:
        products = joins.upsert(stored, current, "product_id", [F.col("_key"), F.col("store")]).drop("change")
        since = stored.select("product_id", F.col("first_seen").alias("_since"))
        products = products.join(since, "product_id", "left").withColumn("first_seen", F.coalesce("_since", "first_seen")).drop("_since")
        rows = log.unionByName(new_log).withColumn("ord", F.lit(0))
        new_log = history.change_log(rows.withColumnRenamed("day", "at"), "product_id", "at", "price", "ord").select("product_id", "day", "price")
    else:
        products = current
    sinks.write_version(products, out.products, day)
    sinks.write_version(history.retain_last(new_log, ["product_id"], [F.desc("day")], keep), out.log, day)
    return out
