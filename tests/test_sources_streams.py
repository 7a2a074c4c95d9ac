"""Readers and sinks on files of a few lines; streams against the batch result."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketgrain.operators import history
from marketgrain.sources import readers, sinks
from marketgrain.streaming import streams


def test_price_file(spark, tmp_path):
    lines = ["﻿store,name,product,code,cat,regular,promo", "1,S,Milk,c1,x,\"2,50\",", "2,S,Oil,,x,5.00,4.00", "3,S,,c3,x,1.00,", "4,S,Tea,c4,x,zero,", "5,S,Jam,c5,x,0,", "6,S", "7,S,Bean,c7,x,3.00,3.50"]
    (tmp_path / "p.csv").write_text("\n".join(lines), encoding="utf-8")
    got = [(r["name"], float(r["price"]), None if r["old_price"] is None else float(r["old_price"]), r["code"]) for r in readers.price_file(spark, str(tmp_path / "p.csv")).orderBy("ord").collect()]
    assert got == [("Milk", 2.5, None, "c1"), ("Oil", 4.0, 5.0, None), ("Bean", 3.5, None, "c7")]
    assert readers.price_file(spark, str(tmp_path / "p.csv"), promos_only=True).count() == 2


HTML = """<html><head><meta property="og:image" content="og.jpg"><script type="application/ld+json">{"@type": "Product", "name": "Milk", "offers": [{"price": "2.50", "priceValidUntil": "2024-05-01"}], "image": ["a.jpg"]}</script></head>
<body><div class="card x"><h3 class="title">Milk &amp; co</h3><img src="m.jpg"><span class="price">1,28 €</span><span class="price">2,50 лв</span></div>
<div class="card"><h3 class="title">Oil<br>extra</h3><span class="price">9</span><div data-json='{"id": 7, "n": "a&amp;b"}'></div></div>
<a href="/fl/one">1</a><a href="/fl/one#x">1</a><a href="/fl/two">2</a><a href="?page=2">2</a><a href="?page=12">12</a></body></html>"""


def pages(spark):
    return spark.createDataFrame([("u1", HTML), ("u2", "<p>nothing"), ("u3", None)], "url string, html string")


def test_html_readers(spark):
    p = pages(spark)
    cards = readers.html_cards(p, "card", {"title": "title", "price": "price", "img": "img@src"}).orderBy("place").collect()
    assert [(r["title"], r["img"]) for r in cards] == [(["Milk & co"], ["m.jpg"]), (["Oilextra"], [])]
    assert [float(x) for x in spark.createDataFrame([(cards[0]["price"],)], "p array<string>").select(readers.paired_prices(F.col("p")).alias("x")).first()["x"]] == [2.5]
    assert [tuple(r) for r in readers.attribute_json(p, "data-json", "id int, n string").select("url", "id", "n").collect()] == [("u1", 7, "a&b")]
    ld = readers.json_ld_products(p).collect()
    assert [(r["name"], r["image"], float(r["price"]), r["valid_until"]) for r in ld] == [("Milk", "a.jpg", 2.5, date(2024, 5, 1))]
    assert [(r["url"], r["link"]) for r in readers.links(p, "/fl/").orderBy("place").collect()] == [("u1", "/fl/one"), ("u1", "/fl/two")]
    assert {r["url"]: r["pages"] for r in readers.last_page(p).collect()} == {"u1": 12, "u2": 1, "u3": 1}


def test_url_encoded_json_and_encodings(spark):
    p = spark.createDataFrame([("u", '<a data-q="%7B%22id%22%3A5%7D">')], "url string, html string")
    assert [r["id"] for r in readers.attribute_json(p, "data-q", "id int", encoded=True).collect()] == [5]
    rows = spark.createDataFrame([(bytearray("мляко", "utf-8"),), (bytearray("мляко", "cp1251"),)], "b binary")
    assert [r[0] for r in rows.select(readers.decoded(F.col("b"))).collect()] == ["мляко", "мляко"]


def test_script_and_json_documents(spark, tmp_path):
    (tmp_path / "t.js").write_text('const X = {"at": 1, "rows": [{"id": "a", "v": 1.5}, {"id": "b", "z": 0}]};\n')
    assert [tuple(r) for r in readers.script_table(spark, str(tmp_path / "t.js"), "id: string, v: double", "rows").collect()] == [(0, "a", 1.5), (1, "b", None)]
    (tmp_path / "t.json").write_text('{"rows": [{"id": "a"}, {"id": "b"}]}')
    assert [r["id"] for r in readers.json_document(spark, str(tmp_path / "t.json"), "rows", "id: string").collect()] == ["a", "b"]
    (tmp_path / "k.txt").write_text("'one': 1, 'two' : 2, 'one':3")
    assert {r["key"] for r in readers.file_keys(spark, str(tmp_path / "k.txt")).collect()} == {"one", "two"}
    (tmp_path / "kv.json").write_text('{"key": "t-2024-01-02", "value": {"walk": true, "read": false}}\n{"key": "other", "value": {}}')
    assert {tuple(r) for r in readers.key_values(spark, str(tmp_path / "kv.json"), "t-").collect()} == {(date(2024, 1, 2), "walk", True), (date(2024, 1, 2), "read", False)}


def test_brochures(spark):
    d = date(2024, 5, 5)
    rows = [("u1", "s", "t", date(2024, 5, 1), date(2024, 5, 9)), ("u2", "s", "t", date(2024, 1, 1), date(2024, 1, 9)), ("u3", "r", "old", date(2024, 1, 1), date(2024, 1, 2)), ("u4", "q", "03.05. - 09.05.2024", None, None), ("u5", "q", "с валидност до 04.05.2024", None, None)]
    got = {(r["url"], r["active"]) for r in readers.active_brochures(spark.createDataFrame(rows, "url string, store string, title string, valid_from date, valid_until date"), d.isoformat()).collect()}
    assert got == {("u1", True), ("u3", False), ("u4", True)}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "id int, v string")
    sinks.write_version(df, str(tmp_path / "t"), "2024-01-01")
    sinks.write_version(df.limit(1), str(tmp_path / "t"), "2024-01-02")
    assert sinks.latest_version(spark, str(tmp_path / "t")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_version(df.limit(0), str(tmp_path / "t"), "2024-01-03")
    doc = sinks.json_envelope(df, "rows", ["id"], {"made": "x"})
    assert json.loads(doc.first()["value"]) == {"made": "x", "total": 2, "rows": [{"id": 1}, {"id": 2, "v": "b"}]}
    assert sinks.script_constant(doc, "X").first()["value"].startswith("const X = {")
    log = spark.createDataFrame([(date(2024, 1, i),) for i in range(1, 9)], "at date")
    assert sinks.append_log(log, spark.createDataFrame([(date(2024, 2, 1),)], "at date"), "at", 3).count() == 3
    cache = sinks.merge_cache(df, spark.createDataFrame([(1, "new"), (5, None)], "id int, v string"), "id")
    assert {tuple(r) for r in cache.collect()} == {(2, "b"), (1, "new"), (5, None)}


def feed(spark, tmp_path):
    """A folder with a file a day, of three keys."""
    rows = []
    for n in range(12):
        day = [(k, datetime(2024, 1, 1) + timedelta(days=n, hours=i), v, n * 10 + i) for i, (k, v) in enumerate([("a", 1.0 + n // 4), ("b", 2.0), ("c", float(n % 3)), ("c", 7.0)])]
        spark.createDataFrame(day, "k string, t timestamp, v double, ord int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        rows += day
    return spark.createDataFrame(rows, "k string, t timestamp, v double, ord int")


def test_change_stream_equals_batch(spark, tmp_path):
    batch = feed(spark, tmp_path)
    stream = streams.parquet_stream(spark, str(tmp_path / "in"), "k string, t timestamp, v double, ord int", files=3)
    streams.run_to_end(streams.change_stream(stream, "k", "t", "v"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["k"], r["day"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {(r["k"], r["day"], r["v"]) for r in history.change_log(batch, "k", "t", "v", "ord").collect()}
    assert got == want


def test_windows_counters_and_log(spark, tmp_path):
    batch = feed(spark, tmp_path)
    schema = "k string, t timestamp, v double, ord int"
    new = lambda: streams.parquet_stream(spark, str(tmp_path / "in"), schema, files=4)
    streams.run_to_end(streams.daily_counts(new(), "t", "k", "1 day"), str(tmp_path / "d"), str(tmp_path / "d_cp"))
    got = {(r["day"], r["k"]): r["n"] for r in spark.read.parquet(str(tmp_path / "d")).collect()}
    want = {(r["day"], r["k"]): r["n"] for r in batch.groupBy(F.to_date("t").alias("day"), "k").agg(F.count("*").alias("n")).collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 9
    streams.run_to_end(streams.weekly_counts(new(), "t", "k", "1 day"), str(tmp_path / "w"), str(tmp_path / "w_cp"))
    assert all(r["week"].weekday() == 0 for r in spark.read.parquet(str(tmp_path / "w")).collect())
    streams.batches_to_end(new(), streams.upsert_counters(str(tmp_path / "c"), "k", "v"), str(tmp_path / "c_cp"))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "c").iterdir() if p.name.startswith("batch="))
    assert {r["k"]: r["n"] for r in spark.read.parquet(str(tmp_path / f"c/batch={last}")).collect()} == {"a": 12, "b": 12, "c": 24}
    streams.batches_to_end(new(), streams.run_log(str(tmp_path / "l"), keep=2), str(tmp_path / "l_cp"))
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "l").iterdir() if p.name.startswith("run="))
    assert spark.read.parquet(str(tmp_path / f"l/run={last}")).count() == 2
