"""Queries of the general data-preparation operators (intervals, units, history, filling)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.operators.impute import fill_offers
from marketgrain.operators.intervals import periods_and_gaps
from marketgrain.operators.units import TOLERANCE, stored_otherwise, with_common_units
from marketgrain.operators.versions import version_history
from marketgrain.plans.impute_sql import MISSING
from marketgrain.plans.measure_sql import differing
from marketgrain.session import table


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods_and_gaps(table(spark, sf_dir, "offers"))
    return out.select("id", "kind", _day("day_from"), _day("day_until"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_otherwise(with_common_units(table(spark, sf_dir, "offers"))).select("ord", "field")


def p4_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row in common units, with the unit in which the stored numbers were recorded and how sure that is."""
    units = with_common_units(table(spark, sf_dir, "offers"))
    return units.select("ord", F.round("content", 3).alias("content"), "content_from", F.round("unit_price", 2).alias("unit_price"), "weight_unit", "price_unit", "route")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = version_history(table(spark, sf_dir, "all_products"))
    return out.select("product_id", _day("version_from"), _day("version_until"))


def p6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version with its values: price in whole stotinki, health score, address of the picture file."""
    out = version_history(table(spark, sf_dir, "all_products"))
    return out.select("product_id", F.col("new_price").cast("bigint").alias("price_cents"), F.col("health_score").cast("int").alias("health_score"), F.col("image").alias("picture"), _day("version_from"), _day("version_until"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_offers(table(spark, sf_dir, "offers")).select("ord", "field")


def p7_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every missing value with what fills it and the way it was filled."""
    return fill_offers(table(spark, sf_dir, "offers"))


QUERIES = {"p7_found": p7_found, "p7_filled": p7_filled, "p3_found": p3_found, "p4_found": p4_found, "p4_units": p4_units, "p6_found": p6_found, "p6_history": p6_history}

_P6 = r"""
WITH d AS (SELECT product_id, CAST(generated_at AS DATE) AS day, generated_at, snap_id, CAST(round(new_price * 100) AS BIGINT) AS c, health_score AS h,
    nullif(regexp_replace(regexp_replace(trim(image), '[?#].*$', ''), '^([hH][tT][tT][pP][sS]?:)?//(www\.)?', ''), '') AS i FROM all_products
    WHERE product_id IS NOT NULL AND generated_at IS NOT NULL),
g AS (SELECT product_id, day, max_by(c, (generated_at, snap_id)) FILTER (c IS NOT NULL) AS c, max_by(h, (generated_at, snap_id)) FILTER (h IS NOT NULL) AS h,
    max_by(i, (generated_at, snap_id)) FILTER (i IS NOT NULL) AS i FROM d GROUP BY ALL),
s AS (SELECT product_id, day, last_value(c IGNORE NULLS) OVER w AS c, last_value(h IGNORE NULLS) OVER w AS h, last_value(i IGNORE NULLS) OVER w AS i
    FROM g WINDOW w AS (PARTITION BY product_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
b AS (SELECT *, lag(c) OVER w AS c0, lag(h) OVER w AS h0, lag(i) OVER w AS i0, row_number() OVER w AS n FROM s WINDOW w AS (PARTITION BY product_id ORDER BY day)),
v AS (SELECT * FROM b WHERE n = 1 OR c IS DISTINCT FROM c0 OR h IS DISTINCT FROM h0 OR i IS DISTINCT FROM i0)
SELECT product_id, {cols} strftime(day, '%Y-%m-%d') AS version_from,
    coalesce(strftime(lead(day) OVER (PARTITION BY product_id ORDER BY day) - INTERVAL 1 DAY, '%Y-%m-%d'), '9999-12-31') AS version_until FROM v
"""

SQL = {
    "p4_found": differing(TOLERANCE),
    "p7_found": MISSING,
    "p3_found": """
WITH r AS (SELECT DISTINCT id, valid_from AS a, valid_until AS b FROM offers WHERE id IS NOT NULL AND valid_from <= valid_until),
m AS (SELECT *, max(b) OVER (PARTITION BY id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
p AS (SELECT id, island, min(a) AS a, max(b) AS b FROM k GROUP BY id, island),
n AS (SELECT *, lead(a) OVER (PARTITION BY id ORDER BY a) AS nxt FROM p)
SELECT id, 'period' AS kind, strftime(a, '%Y-%m-%d') AS day_from, strftime(b, '%Y-%m-%d') AS day_until FROM n
UNION ALL SELECT id, 'gap', strftime(b + 1, '%Y-%m-%d'), strftime(nxt - 1, '%Y-%m-%d') FROM n WHERE nxt IS NOT NULL
""",
    "p6_found": _P6.replace("{cols}", ""),
    "p6_history": _P6.replace("{cols}", "c AS price_cents, h AS health_score, i AS picture,"),
}
