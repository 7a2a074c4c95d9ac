"""General operators on small tables, with nulls, ties and empty inputs."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketgrain.functions import rules, scalars
from marketgrain.operators import dedupe, history, joins, rank, scoring, texts
from marketgrain.plans.offers_query import has_word, in_stores


def one(spark, column, *rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_keep_best_ties_nulls_empty(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 1), (None, 5, 3), (None, 4, 4), ("b", None, 5)], "k string, v int, ord int")
    got = {(r["k"], r["ord"]) for r in dedupe.keep_best(df, ["k"], [F.desc("v"), F.col("ord")]).collect()}
    assert got == {("a", 1), (None, 3), ("b", 5)}
    assert dedupe.keep_best(df.limit(0), ["k"], ["ord"]).count() == 0


def test_merge_groups_and_unions(spark):
    df = spark.createDataFrame([("x", "s2", 2.0), ("x", "s1", 3.0), (None, "s1", 1.0)], "name string, store string, price double")
    got = {r["name"]: (r["store"], r["members"], r["stores"]) for r in dedupe.merge_groups(df, ["name"], [F.col("price")], {"stores": F.col("store")}).collect()}
    assert got == {"x": ("s2", 2, ["s1", "s2"]), None: ("s1", 1, ["s1"])}
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (None, "d")], "k int, v string")
    assert {tuple(r) for r in dedupe.add_unseen(a, b, ["k"]).collect()} == {(1, "a"), (2, "c"), (None, "d")}
    assert {tuple(r) for r in dedupe.union_first([a, b], ["k"], ["v"]).collect()} == {(1, "a"), (2, "c"), (None, "d")}


def test_numbered_ids_and_unique_take(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "base string, o int")
    assert {tuple(r) for r in dedupe.numbered_ids(df, "base", ["o"], "id").select("o", "id").collect()} == {(1, "a"), (2, "a-2"), (3, "a-3"), (1, "b")}
    assert [tuple(r) for r in dedupe.take_unique(df, F.col("base"), [F.desc("o")], 5).collect()] == [("a", 3), ("b", 1)]


def test_upsert(spark):
    stored = spark.createDataFrame([("p1", "milk", 1), ("p2", "oil", 2), ("p3", "tea", 3), ("p4", None, 4)], "pid string, name string, v int")
    current = spark.createDataFrame([("p1", "milk!", 10), ("n2", "oil", 20), ("n9", "jam", 30), ("n8", None, 40)], "pid string, name string, v int")
    got = {(r["pid"], r["change"], r["v"]) for r in joins.upsert(stored, current, "pid", [F.col("name")]).collect()}
    assert got == {("p1", "same", 10), ("n2", "moved", 20), ("n9", "new", 30), ("n8", "new", 40), ("p3", "kept", 3), ("p4", "kept", 4)}


def test_band_join_borders(spark):
    left = spark.createDataFrame([("g", 0.0, 0.0)], "g string, x double, y double")
    right = spark.createDataFrame([("g", 400.0, 120.0), ("g", 401.0, 0.0), ("g", 0.0, 121.0), ("g", -400.0, -120.0), ("h", 0.0, 0.0), (None, 0.0, 0.0)], "g string, x double, y double")
    got = {(r["r_x"], r["r_y"]) for r in joins.band_join(left, right, ["g"], "x", "y", 400.0, 120.0).collect()}
    assert got == {(400.0, 120.0), (-400.0, -120.0)}


def test_nearest_and_fuzzy(spark):
    left = spark.createDataFrame([(1, "a", 1.0, 1.0), (2, "a", None, 1.0), (3, "z", 1.0, 1.0)], "id int, k string, p double, f double")
    right = spark.createDataFrame([("a", 5.0, 5.0, 1), ("a", 1.5, 1.0, 2), ("a", 0.5, 1.0, 3)], "k string, p double, f double, ord int")
    got = {r["id"]: r["r_ord"] for r in joins.nearest_l1(left, right, ["k"], ["p", "f"], "id", "ord", ["ord"]).collect()}
    assert got == {1: 2, 2: 1, 3: None}
    a = spark.createDataFrame([(1, "Red apple juice"), (2, "zzz"), (3, None)], "a int, t string")
    b = spark.createDataFrame([(7, "apple juice red"), (8, "apple pie")], "b int, u string")
    best = joins.fuzzy_best(a, b, "a", "t", "b", "u").collect()
    assert [(r["a"], r["b"]) for r in best] == [(1, 7)] and best[0]["score"] == 1.0


def test_enrich_cache_and_share(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, None, "y")], "id int, k string, image string")
    right = spark.createDataFrame([("a", "pic", "n1")], "key string, image string, extra string")
    got = {r["id"]: (r["image"], r["extra"]) for r in joins.enrich(left, right, F.col("k"), "key", ["extra"], {"image": F.col("image").isNull()}).collect()}
    assert got == {1: ("pic", "n1"), 2: ("x", None), 3: ("y", None)}
    rows, missing = joins.cache_probe(left, right.withColumnRenamed("key", "k").select("k", "extra"), "k")
    assert rows.count() == 3 and [r["k"] for r in missing.collect()] == ["b"]
    shared = joins.share_first(left.withColumn("g", F.lit("g")), "g", "image", F.col("image").isNotNull(), ["id"])
    assert {r["id"]: r["image"] for r in shared.collect()} == {1: "x", 2: "x", 3: "y"}


def test_small_checks_size(spark):
    df = spark.range(10)
    plan = lambda d: spark.range(100000).join(d, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.small(df, 10)).lower() and "strategy=broadcast" not in plan(joins.small(df, 9))


def test_change_log_same_day_and_trend(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    rows = [("a", at(1), 1.0, 1), ("a", at(1, 5), 2.0, 2), ("a", at(2), 1.0, 3), ("a", at(3), 3.0, 4), ("a", at(4), None, 5), ("b", at(1), 0.0, 6), ("b", at(2), 1.0, 7)]
    log = history.change_log(spark.createDataFrame(rows, "k string, t timestamp_ntz, v double, ord int"), "k", "t", "v", "ord")
    assert {(r["k"], r["day"].day, r["v"]) for r in log.collect()} == {("a", 1, 1.0), ("a", 3, 3.0), ("b", 1, 0.0), ("b", 2, 1.0)}
    got = history.trend(log, "k", "day", "v").collect()
    assert [(r["k"], r["direction"]) for r in got] == [("a", "up")]
    stats = {r["k"]: (r["entries"], r["lowest"], r["lowest_day"]) for r in history.log_statistics(log, "k", "day", "v").collect()}
    assert stats["a"] == (2, 1.0, date(2024, 1, 1))


def test_retention_keeps_newest(spark):
    df = spark.range(110).select(F.lit("k").alias("k"), F.col("id").alias("n"))
    kept = [r["n"] for r in history.retain_last(df, ["k"], [F.desc("n")], 104).collect()]
    assert min(kept) == 6 and len(kept) == 104


def test_pages_join_to_the_whole(spark):
    df = spark.range(95).select(F.col("id").alias("n"))
    pages = [[r["n"] for r in rank.page(df, [F.col("n")], i, 36).collect()] for i in (1, 2, 3)]
    assert sum(pages, []) == list(range(95))
    assert rank.page(df, [F.col("n")], 9, 36).count() == 23 and rank.page(df.limit(0), [F.col("n")], 1).count() == 0
    assert rank.page_of(df, [F.col("n")], F.col("n") == 40, 36).first()["number"] == 2
    assert rank.page_links(1, 9) == [1, 2, 3] and rank.page_links(9, 9) == [7, 8, 9]


def test_pack_resets_and_keeps_long_texts_whole(spark):
    rows = [("g", 1, 6), ("g", 2, 5), ("g", 3, 30), ("g", 4, None), ("g", 5, 1), ("h", 1, 9), (None, 1, 1)]
    got = {(r["g"], r["o"]): r["chunk"] for r in texts.pack(spark.createDataFrame(rows, "g string, o int, n int"), "g", "o", "n", 10).collect()}
    assert got == {("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 3, ("g", 5): 3, ("h", 1): 0, (None, 1): 0}


def test_flags_search_names(spark):
    f = texts.flags(F.col("t"), {"E202": ("k", "amber"), "E621": ("g", "red")}, [("нишесте", "n", "amber"), ("захар", "z", "red")])
    got = one(spark, F.transform(f, lambda x: x["match"]), "Захар, Е-202, нишесте, E 621, e202", "", None)
    assert got == [["E621", "захар", "E202", "нишесте"], [], None]
    assert one(spark, texts.search_text([F.col("t")], [["тон", "tuna"], ["x", "y"]]), "Риба ТОН", None) == ["риба тон тон tuna", ""]
    near = spark.createDataFrame([(1, "Fresh Milk", 1.0, 1.0), (1, "2,50 лв", 2.0, 1.0), (1, "milk 3% X", 3.0, 0.0), (1, "Milk", 4.0, 0.0)], "k int, t string, y double, x double")
    assert texts.assemble_names(near, "k", "t", "y", "x", ["лв"]).first()["name"] == "Fresh Milk milk"


def test_rules(spark):
    n = F.col("t")
    assert one(spark, rules.first_of(n, rules.longest_first([("боб", 1), ("зелен боб", 2)]), 0), "Зелен боб", "боб", "x", None) == [2, 1, 0, 0]
    assert one(spark, rules.any_of(n, ["А", "b"]), "ха", None, "") == [True, False, False]
    assert one(spark, rules.tags_of(n, {"k": ["a"], "l": ["b"]}, {"k": ["c"]}), "ab", "abc", None) == [["k", "l"], ["l"], []]
    with pytest.raises(ValueError):
        rules.first_rule_join(spark.range(1).select(F.lit("a").alias("t")), "t", spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, v int, o int"), "k", "v", "o", "x", most_rules=1)


def test_scalars(spark):
    t = F.col("t")
    assert [None if p is None else float(p) for p in one(spark, scalars.parse_price(t), "12,50 лв.", "цена 3.99", "7", "няма", None, "100 г")] == [12.5, 3.99, 7.0, None, None, None]
    assert one(spark, scalars.parse_date(t, F.lit(2025)), "2024-02-30", "1.02.2024", "01.02.24 г.", "31.04.", "5.03", None) == [None, date(2024, 2, 1), date(2024, 2, 1), None, date(2025, 3, 5), None]
    r = one(spark, scalars.date_range(t), "29.12. - 04.01.2026")[0]
    assert r["day_until"] == date(2026, 1, 4)
    assert one(spark, scalars.moment_to_date(t), "2024-05-01T10:00:00Z", "2024-05-02 xx", "no") == [date(2024, 5, 1), date(2024, 5, 2), None]
    assert one(spark, scalars.last_of_srcset(t), "a.jpg 1x, b.jpg 2x", "") == ["b.jpg", None]
    assert one(spark, scalars.match_name(t), "Мляко, 3,6% 500 г!") == ["мляко 3 6"]
    assert one(spark, scalars.jaccard(scalars.tokens(t), scalars.tokens(F.lit("one two three"))), "two three four", "", None) == [0.5, 0.0, 0.0]
    assert one(spark, scalars.sequence_ratio(t, F.lit("abcd")), "abcd", "", None) == [1.0, 0.0, None]
    assert one(spark, scalars.html_unescape(scalars.html_escape(t)), "<a href=\"x\">'&'</a>", None) == ["<a href=\"x\">'&'</a>", None]
    assert one(spark, scalars.script_string(t), "a'b\\\n") == ["a\\'b\\\\\\n"]
    assert one(spark, scalars.slug(t), "  Crème Brûlée – 100 г ") == ["creme-brulee-100-г"]
    assert one(spark, scalars.repair_mixed_script(t), "Mляко Milk") == ["Мляко Milk"]
    assert one(spark, scalars.additive_codes(t), "E 150d, е202 E202 x") == [["E150D", "E202"]]


def test_scoring(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, -1)], "id int, x int")
    rows = scoring.additive(df, ["m", "f"], [(F.col("x") > 0, {"f": 3, "m": 3}), (F.col("x") < 0, {"f": 1})])
    got = {r["id"]: ([y["name"] for y in r["r"]], r["l"], r["b"]) for r in rows.select("id", scoring.ranked_profiles(["m", "f"]).alias("r"), scoring.lowest_profile(["m", "f"]).alias("l"), scoring.banded(F.col("x"), [(0, "low")], "high").alias("b")).collect()}
    assert got == {1: (["m", "f"], "m", "high"), 2: (["m", "f"], "m", None), 3: (["f", "m"], "m", "low")}


def test_predicates(spark):
    df = spark.createDataFrame([(1, None, "a", "x y"), (2, ["b"], "a", "z")], "id int, available_stores array<string>, store string, words string")
    assert [r["id"] for r in df.where(in_stores("a")).collect()] == [1]
    assert [r["id"] for r in df.where(has_word("words", "y")).collect()] == [1]
