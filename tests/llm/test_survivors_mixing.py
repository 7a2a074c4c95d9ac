"""Survivors against a per-group loop; the mixture against its definition."""

import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from marketgrain.llm.mixing import mix, schedule_time, source_key, token_counts
from marketgrain.llm.survivors import PER_STORE, survivors

SCHEMA = "ord long, id string, store string, name string, emoji string, category string, valid_from date, valid_until date, source_type string, image string, macros struct<kcal: double, p: double, f: double, c: double>, generated_at timestamp_ntz"


def offers(seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(500):
        e = r.randrange(60)
        image = r.choice([None, "", "images/placeholder.svg", f"https://x/{e}.webp", f"https://x/{e}.webp", "https://x/shared.webp"])
        macros = r.choice([None, (-1.0,) * 4, (1.0, 2.0, 3.0, None), (100.0 + e, 2.0, 3.0, 4.0), (0.0,) * 4])
        rows.append((i, f"id{e}", "s", f"дума{e % 5} име", f"e{e % 5}", f"c{e % 5}", r.choice([None, date(2024, 1, 1)]), date(2024, 1, 9), r.choice([None, "promo", "catalog"]), image, macros, datetime(2024, 1, 1 + i % 9)))
    return rows


def test_put_together(spark):
    rows = offers()
    got = survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    groups: dict = {}
    for x in rows:
        groups.setdefault((x[1], x[6], x[7]), []).append(x)
    assert len(got) == len(groups)
    uses: dict = {}
    for x in rows:
        uses.setdefault(x[9], set()).add(x[1])
    picture = lambda x: bool(x[9]) and "placeholder" not in x[9] and "shared" not in x[9]
    macros = lambda x: x[10] is not None and all(v is not None and v >= 0 for v in x[10]) and any(x[10])
    for g in got:
        members = groups[g["id"], g["valid_from"], g["valid_until"]]
        p, m, both = any(map(picture, members)), any(map(macros, members)), any(picture(x) and macros(x) for x in members)
        assert g["rows"] == len(members) and g["first_ord"] == min(x[0] for x in members)
        assert (g["image"] is not None) == p and (g["macros"] is not None) == m
        assert g["put_together"] == (len(members) >= 2 and p and m and not both)
        best = max(members, key=lambda x: (picture(x) + macros(x) + bool(x[8]), {"catalog": 4, "promo": 2, None: 0}[x[8]], x[11], -x[0]))
        assert g["ord"] == best[0]


def test_survivor_edges(spark):
    assert survivors(spark.createDataFrame([], SCHEMA)).collect() == []
    blank = (1, None, None, None, None, None, None, None, None, None, None, None)
    got = survivors(spark.createDataFrame([blank, (2, *blank[1:])], SCHEMA)).collect()
    assert len(got) == 1 and got[0]["rows"] == 2 and not got[0]["put_together"]
    many = [(i, f"i{i}", "s", "n", "e", "c", None, None, None, "https://x/one.webp", None, None) for i in range(PER_STORE + 1)]
    assert all(r["image"] is None for r in survivors(spark.createDataFrame(many, SCHEMA)).collect())
    few = [(i, f"i{i}", f"s{i}", "n", "e" if i or same else "f", "c", None, None, None, "https://x/one.webp", None, None) for same in (True, False) for i in range(40) if same or i < 2]
    assert all(r["image"] for r in survivors(spark.createDataFrame(few[:40], SCHEMA)).collect())  # one item in many stores
    assert not any(r["image"] for r in survivors(spark.createDataFrame(few[40:], SCHEMA)).collect())  # two kinds of item


def test_values_field_by_field(spark):
    """Each field comes from the best record that has a true value of it: completeness, trust, recency, smallest ord."""
    rows = offers(11)
    got = {(g["id"], g["valid_from"], g["valid_until"]): g for g in survivors(spark.createDataFrame(rows, SCHEMA)).collect()}
    picture = lambda x: bool(x[9]) and "placeholder" not in x[9] and "shared" not in x[9]
    macros = lambda x: x[10] is not None and all(v is not None and v >= 0 for v in x[10]) and any(x[10])
    trust = {"catalog": 4, "promo": 2, None: 0}
    full = lambda x: picture(x) + macros(x) + bool(x[8])
    order = lambda x: (full(x), trust[x[8]], x[11], -x[0])
    groups: dict = {}
    for x in rows:
        groups.setdefault((x[1], x[6], x[7]), []).append(x)
    for k, members in groups.items():
        image = max(filter(picture, members), key=order, default=None)
        food = max(filter(macros, members), key=order, default=None)
        kind = max((x for x in members if x[8]), key=lambda x: (trust[x[8]], full(x), x[11], -x[0]), default=None)
        assert got[k]["image"] == (image and image[9]) and got[k]["source_type"] == (kind and kind[8])
        assert (got[k]["macros"] and tuple(got[k]["macros"])) == (food and food[10])


def corpus(spark, n=900):
    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "a", " A", "b", "c-d"]) , " ".join(r.choice(["хляб", "milk", "40", "леща"]) for _ in range(r.randrange(1, 60)))) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, text string")


def test_shares_caps_and_order(spark):
    pytest.importorskip("tiktoken")
    docs = corpus(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.2, 3), ("c_d", 0.3, 2)], "source string, target_share double, max_repeats int")
    mixture, report = mix(docs, targets)
    shares = {r["source"]: r for r in report.collect()}
    assert all(abs(r["actual_share"] - r["target_share"]) < 0.005 for r in shares.values())
    rows = mixture.collect()
    caps = {"a": 1, "b": 3, "c_d": 2}
    uses: dict = {}
    for x in rows:
        assert 1 <= x["use"] <= caps[x["source"]] and 0 <= x["position"] <= 1
        uses.setdefault(x["doc_id"], []).append(x["use"])
    assert all(sorted(u) == list(range(1, len(u) + 1)) for u in uses.values())
    positions = [x["position"] for x in rows]
    assert positions == sorted(positions)
    # the tokens of a source up to a time follow the integral of its schedule
    total = sum(x["tokens"] for x in rows)
    for s, slope in (("a", -0.5), ("b", 0.5)):
        half = sum(x["tokens"] for x in rows if x["source"] == s and x["position"] < 0.5) / total
        share = shares[s]["target_share"]
        assert half == pytest.approx(share * (0.5 - slope * 0.25), abs=0.02)


def test_large_total_reports_the_shortfall(spark):
    docs = corpus(spark, 200)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), ("nothing", 0.0, 1)], "source string, target_share double, max_repeats int")
    have = {r["source"]: r["t"] for r in docs.select(source_key(F.col("source")).alias("source"), token_counts(F.col("text")).alias("t")).groupBy("source").agg(F.sum("t").alias("t")).collect()}
    got = {r["source"]: r["tokens"] for r in mix(docs, targets, total=10**7)[1].collect()}
    assert got == {"a": have["a"], "b": have["b"]}


def test_missing_and_binding_sources(spark):
    """A target source without documents does not empty the mixture; the report names it and the source that bounds it."""
    docs = corpus(spark)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.1, 1), ("nowhere", 0.4, 3)], "source string, target_share double, max_repeats int")
    mixture, report = mix(docs, targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["nowhere"]["state"] == "missing" and got["nowhere"]["tokens"] == 0 and got["nowhere"]["actual_share"] == 0
    assert abs(got["a"]["actual_share"] - 5 / 6) < 0.005 and abs(got["b"]["actual_share"] - 1 / 6) < 0.005
    assert {got["a"]["state"], got["b"]["state"]} == {"binding", "spare"}
    assert mixture.count() == sum(r["uses"] for r in got.values())
    short = {r["source"]: r["state"] for r in mix(docs, targets, total=10**7)[1].collect()}
    assert short == {"a": "short", "b": "short", "nowhere": "missing"}
    # against the definition: documents in the order of their hash, each used while half of it lies within the need
    one = mix(docs.where("source IN ('a', ' A')"), spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"), total=9000)
    rows = one[0].orderBy("use", "position").collect()
    begin, expected = 0, []
    for x in rows:
        if begin + x["tokens"] / 2 <= 9000:
            expected.append((x["doc_id"], x["use"]))
        t = begin / 9000
        assert x["position"] == pytest.approx((t * 2 / (0.5 + (0.25 + 2 * t) ** 0.5)), abs=1e-9)
        begin += x["tokens"]
    assert [(x["doc_id"], x["use"]) for x in rows] == expected and abs(begin - 9000) < 60


def test_mixing_edges(spark):
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    mixture, report = mix(empty, targets)
    assert mixture.collect() == [] and [r["tokens"] for r in report.collect()] == [0]
    odd = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "x"), (4, "a", "дълъг текст " * 20000), (5, "z", "y")], empty.schema)
    assert {r["doc_id"] for r in mix(odd, targets)[0].collect()} == {4}


def test_schedule_inverts(spark):
    parts = [i / 20 for i in range(21)]
    for slope in (-1.0, -0.3, 0.0, 0.4, 1.0):
        df = spark.createDataFrame([(p,) for p in parts], "p double").select("p", schedule_time(F.col("p"), F.lit(slope)).alias("t"))
        for r in df.collect():
            assert (1 - slope) * r["t"] + slope * r["t"] ** 2 == pytest.approx(r["p"], abs=1e-9) and -1e-9 <= r["t"] <= 1 + 1e-9
