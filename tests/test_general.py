"""Derived values, matching of stated queries, reports and pages, against plain Python."""

import difflib
import random

from pyspark.sql import functions as F

from marketgrain.functions import metrics
from marketgrain.operators import joins, rank, texts
from marketgrain.plans.offers_query import offers_query


def test_fuzzy_best_is_brute_force(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(1, 6)))
    left = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(40)} | {"", "日本語", "x" * 3000})
    right = sorted({" ".join(word() for _ in range(r.randint(1, 3))) for _ in range(90)} | {"", "日本"})
    got = {x["a"]: (x["b"], x["score"]) for x in joins.fuzzy_best(spark.createDataFrame([(x,) for x in [*left, None]], "a string"), spark.createDataFrame([(x,) for x in [*right, None]], "b string"), "a", "a", "b", "b", 0.3, block=7, parts=3).collect()}

    def score(x, y):
        a, b = set(joins.words(x)), set(joins.words(y))
        return max(difflib.SequenceMatcher(None, x, y).ratio(), len(a & b) / len(a | b) if a and b else 0.0)

    want = {}
    for x in left:
        s, y = min((-score(x, y), y) for y in right)
        if -s >= 0.3:
            want[x] = (y, -s)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)
    assert joins.fuzzy_best(spark.createDataFrame([], "a string"), spark.createDataFrame([("x",)], "b string"), "a", "a", "b", "b").collect() == []


def test_pages_without_a_count(spark):
    df = spark.range(80).withColumnRenamed("id", "ord")
    of = lambda n: [x[0] for x in rank.page(df, [F.col("ord")], n).collect()]
    assert of(1) == of(0) == list(range(36)) and of(2) == list(range(36, 72)) and of(3) == of(99) == list(range(72, 80))
    assert rank.page(df.limit(0), [F.col("ord")], 2).collect() == []


def test_unique_top_and_until_empty(spark):
    rows = [(1, "a", 5), (2, "a", 9), (3, "b", 7), (4, None, 99), (5, "c", 1)]
    df = spark.createDataFrame(rows, "ord long, k string, v int")
    assert [(r["ord"], r["place"]) for r in rank.unique_top(df, "k", [F.desc("v"), F.col("ord")], 2).orderBy("place").collect()] == [(2, 1), (3, 2)]
    assert rank.unique_top(df.where("k = 'c'"), "k", [F.desc("v")], 5, least=2).collect() == []
    pages = spark.createDataFrame([("x", 1, 4), ("x", 2, 0), ("x", 3, 5), ("y", 1, 0), ("z", 1, 3)], "s string, p int, n int")
    assert sorted((r["s"], r["p"]) for r in joins.until_empty(pages, "s", "p", F.col("n") == 0).collect()) == [("x", 1), ("z", 1)]


def test_two_keys_last_wins(spark):
    stored = spark.createDataFrame([(1, "p", "n", "s"), (2, "p", "m", "s"), (3, None, "n", "s"), (4, "q", None, "s")], "snap long, pid string, name string, store string")
    df = spark.createDataFrame([(1, "p", "zz", "s"), (2, "none", "n", "s"), (3, None, None, None)], "ord long, pid string, name string, store string")
    assert {r["ord"]: r["snap"] for r in joins.by_two_keys(df, stored, ["pid"], ["name", "store"], "snap", ["snap"]).collect()} == {1: 2, 2: 3, 3: None}


def test_metrics_edges(spark):
    df = spark.createDataFrame([(1, 0.0, 100, 4.0), (2, None, 50, 4.0), (3, 10.0, 5, 8.0), (4, float("nan"), None, 1.0), (5, None, None, None)], "i int, old double, d int, new double")
    got = {r["i"]: (r["o"], r["p"], r["k"]) for r in df.select("i", metrics.derived_old_price(F.col("old"), F.col("new"), F.col("d")).alias("o"), metrics.derived_discount(F.col("old"), F.col("new"), F.col("d")).alias("p"), metrics.promotion_or_not(metrics.positive(F.col("old")), F.col("d")).alias("k")).collect()}
    assert got == {1: (None, 100, "promo"), 2: (8.0, 50, "promo"), 3: (10.0, 20, "promo"), 4: (None, None, "assortment"), 5: (None, None, "assortment")}
    names = spark.createDataFrame([("1. Сирене  краве *-",), ("@@@@ %%%%",), (None,), ("",)], "n string")
    assert [tuple(r) for r in names.select(metrics.clean_name(F.col("n")), metrics.unreadable(F.col("n"))).collect()] == [("Сирене краве", False), ("@@@@ %%%%", True), (None, True), ("", False)]
    maps = spark.sql("SELECT map('a', 1, 'b', 2) x, map('b', 3) y UNION ALL SELECT null, map('c', 1) UNION ALL SELECT map('a', 1), null")
    assert [r[0] for r in maps.select(metrics.merged(F.col("x"), F.col("y"))).collect()] == [{"a": 1, "b": 3}, {"c": 1}, {"a": 1}]


def test_weighted_search_and_history(spark):
    df = spark.createDataFrame([(1, "млечен шоколат", "s"), (2, "хляб", "шоколад"), (3, None, ""), (4, "шоколад", "шоколад")], "ord long, name string, store string")
    got = {r["ord"]: r["score"] for r in texts.weighted_search(df, "ord", {"name": 0.55, "store": 0.12}, " ШОКОЛАД").collect()}
    assert set(got) == {1, 2, 4} and got[4] < got[2] < got[1] or got[4] < got[1] < 1
    assert texts.weighted_search(df, "ord", {"name": 1.0}, "x").collect() == []
    rows = [(i, f"име {i}", "s", "c", 1.0, 0, [1.0] * n) for i, n in enumerate((1, 3, 2))]
    listed = offers_query(spark.createDataFrame(rows, "ord long, name string, store string, category string, new_price double, discount_pct int, price_history array<double>"), sort="history")
    assert [r["ord"] for r in listed.collect()] == [1, 2, 0]


def test_numbered_ids_of_a_hot_base(spark):
    from marketgrain.operators.dedupe import numbered_ids

    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(3000)]
    got = {r["i"]: r["id"] for r in numbered_ids(spark.createDataFrame(rows, "i long, b string"), "b", [F.desc("i")], "id").collect()}
    seen: dict = {}
    for i, b in reversed(rows):
        seen[b] = seen.get(b, 0) + 1
        assert got[i] == (b if seen[b] == 1 else f"{b}-{seen[b]}" if b else str(seen[b]))
    assert len(got) == 3000


def test_envelope_is_bounded(spark):
    import pytest

    from marketgrain.sources.sinks import json_envelope

    with pytest.raises(ValueError):
        json_envelope(spark.range(11), "rows", ["id"], most=10)
    assert json_envelope(spark.range(2), "rows", ["id"], most=10).first()["value"] == '{"total":2,"rows":[{"id":0},{"id":1}]}'
