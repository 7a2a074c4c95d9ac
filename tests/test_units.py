"""Contents in words, the unit model and its calibration."""

import random

import pytest
from pyspark.sql import functions as F

from marketgrain.functions.measure import stated
from marketgrain.operators.units import calibration_steps, stored_otherwise, with_common_units

SCHEMA = "ord long, id string, store string, name string, emoji string, category string, new_price double, weight_raw string, weight_grams int, price_per_kg double, source string, source_type string"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("700 грама", (700, 1)), ("0,500 кг × 4", (500, 4)), ("4 х 85 гр.", (85, 4)), ("6 бр. по 8 oz", (226.796, 6)), ("половин килограм", (500, 1)), ("1/2 КГ", (500, 1)),
        ("ок. ½ кг", (500, 1)), ("33 сл", (330, 1)), ("1 000 Г", (1000, 1)), ("1,000 кг", (1000, 1)), ("Net weight: 180 g × 4", (180, 4)), ("3x125g", (125, 3)), ("1 lb", (453.592, 1)),
        ("1 кг и 500 г", (1500, 1)), ("10 бр.", None), ("", None), (None, None), ("Омега-3 линия", None), ("28-30% 200 гр.", (200, 1)), ("тип 500 1 кг", (1000, 1)), ("3000 милилитра", (3000, 1)),
        ("２ｘ２５０ｇ", (250, 2)), ("1⁠000г", (1000, 1)), ("0 г", None), ("2 пласта", None), ("1,500 g", (1500, 1)), ("0.75l", (750, 1)),
    ],
)
def test_stated(spark, text, expected):
    r = spark.createDataFrame([(text,)], "t string").select(stated(F.col("t")).alias("s")).first()["s"]
    if expected is None:
        assert r["total"] is None
    else:
        assert r["each"] == pytest.approx(expected[0], rel=1e-4) and r["pieces"] == expected[1] and r["total"] == pytest.approx(expected[0] * expected[1], rel=1e-4)


def test_counts(spark):
    rows = spark.createDataFrame([("10 бр.",), ("24 pcs по-изгодно",), ("6 бр. по 8 oz",)], "t string").select(stated(F.col("t"))["count"]).collect()
    assert [r[0] for r in rows] == [10, 24, None]


def test_calibration_rises():
    steps = calibration_steps([(0.5, 10, 6), (0.6, 10, 4), (0.8, 20, 18), (1.0, 50, 50)])
    assert [s for _, s in steps] == sorted(s for _, s in steps) and steps[-1] == (1.0, 1.0)
    assert calibration_steps([]) == [(1.0, 0.0)]


def _rows(n=1500):
    r = random.Random(1)
    rows, truth = [], {}
    for i in range(n):
        grams = r.choice([200, 250, 400, 500, 1000])
        unit, stored = r.choices([("g", grams), ("mg", grams * 1000), ("dag", grams // 10)], [0.9, 0.05, 0.05])[0]
        price = round(grams * r.uniform(0.005, 0.006), 2)
        told = f"{grams} г" if i % 5 else None
        ppk = round(price / grams * 1000, 2)
        ppk_unit, ppk = r.choices([("per_kg", ppk), ("stotinki_per_kg", ppk * 100)], [0.9, 0.1])[0]
        rows.append((i, f"s-{i}", "S", "Масло", "e", "fat", price, told, stored, ppk, "csv", "promo"))
        truth[i] = (unit, grams, told is not None, ppk_unit)
    return rows, truth


def test_model_converts_and_reports(spark):
    rows, truth = _rows()
    units = with_common_units(spark.createDataFrame(rows, SCHEMA)).cache()
    got = {r["ord"]: r for r in units.collect()}
    assert len(got) == len(rows)
    silent = [i for i, t in truth.items() if not t[2]]
    sure = [i for i in silent if got[i]["route"] == "done"]
    assert len(sure) > 0.8 * len(silent)
    assert sum(abs(got[i]["content"] / truth[i][1] - 1) < 0.01 for i in sure) >= 0.97 * len(sure)
    found = {(r["ord"], r["field"]) for r in stored_otherwise(units).collect()}
    assert found == {(i, "weight_grams") for i, t in truth.items() if t[2] and t[0] != "g"} | {(i, "price_per_kg") for i, t in truth.items() if t[2] and t[3] != "per_kg"}


def test_text_hidden_units_are_told_and_routed(spark):
    """Held-out quality: texts hidden, the model's conversions are right, its confidence holds, doubt goes to review."""
    rows, truth = _rows(3000)
    got = {r["ord"]: r for r in with_common_units(spark.createDataFrame(rows, SCHEMA)).collect()}
    silent = [i for i, t in truth.items() if not t[2]]
    right = [got[i]["weight_unit"] == truth[i][0] for i in silent]
    assert abs(sum(right) / len(right) - sum(got[i]["weight_confidence"] for i in silent) / len(silent)) < 0.05
    assert all((got[i]["route"] == "done") == (got[i]["content"] is not None) for i in got)
    assert all(got[i]["route"] == ("done" if got[i]["weight_confidence"] >= 0.9 else "review") for i in silent if got[i]["weight_unit"] != "other")
    strict = with_common_units(spark.createDataFrame(rows, SCHEMA), confident=1.01).where("content IS NULL").select("route", "unit_price_from").distinct().collect()
    assert [tuple(r) for r in strict] == [("review", None)]


def test_nulls_empty_and_unlabelled(spark):
    assert with_common_units(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, None, None, None, None, None, None, None, None, None, None), (2, "a", "s", "", "e", "c", 2.0, "", 0, 0.0, "s", "t"), (2, "a", "s", "", "e", "c", 2.0, "", 0, 0.0, "s", "t"), (3, "a", "s", "x" * 100000, "e", "c", -1.0, "?", -5, -2.0, "s", "t")]
    got = with_common_units(spark.createDataFrame(rows, SCHEMA + "")).withColumn("extra", F.lit(1)).collect()
    assert len(got) == 4 and all(r["content"] is None and not r["weight_differs"] for r in got)
    assert sorted((r["ord"], r["route"]) for r in got) == [(1, "nothing"), (2, "review"), (2, "review"), (3, "review")]
