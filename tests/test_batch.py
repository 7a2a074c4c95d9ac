"""Runs of the pipeline over three days."""

from pyspark.sql import functions as F

from marketgrain.plans import batch
from marketgrain.sources.sinks import latest_version

SCHEMA = "ord int, name string, store string, source string, new_price double, old_price double"


def test_three_days(spark, tmp_path):
    day = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    root = str(tmp_path)
    first = [day(("Milk", "A", "csv", 2.0, None), ("milk ", "A", "csv", 2.0, 3.0), ("Milk", "B", "csv", 1.5, None)), day(("Oil", "A", "web", 5.0, None), ("Milk", "A", "web", 9.0, None))]
    out = batch.run(spark, first, root, "2024-01-01", {"csv": 3})
    offers = {r["_key"]: r for r in latest_version(spark, out.offers).collect()}
    assert set(offers) == {"milk", "oil"}
    milk = offers["milk"]
    assert (milk["store"], milk["comparison_count"], milk["available_stores"], milk["best_price"], milk["best_price_store"]) == ("B", 2, ["A", "B"], 1.5, "B")
    batch.run(spark, [day(("Milk", "B", "csv", 1.5, None))], root, "2024-01-02")
    batch.run(spark, [day(("Milk", "B", "csv", 1.7, None), ("Tea", "A", "csv", 4.0, None))], root, "2024-01-03")
    products = {r["_key"]: (str(r["first_seen"]), str(r["last_seen"])) for r in latest_version(spark, out.products).collect()}
    assert products == {"milk": ("2024-01-01", "2024-01-03"), "oil": ("2024-01-01", "2024-01-01"), "tea": ("2024-01-03", "2024-01-03")}
    log = latest_version(spark, out.log).withColumn("day", F.col("day").cast("string"))
    assert {(r["product_id"].split("-")[1], r["day"], r["price"]) for r in log.collect()} == {("milk", "2024-01-01", 1.5), ("milk", "2024-01-03", 1.7), ("oil", "2024-01-01", 5.0), ("tea", "2024-01-03", 4.0)}


def test_nothing_is_not_published(spark, tmp_path):
    import pytest

    with pytest.raises(ValueError):
        batch.run(spark, [spark.createDataFrame([], SCHEMA)], str(tmp_path), "2024-01-01")
