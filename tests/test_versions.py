"""Version history against a day-by-day replay."""

import random
from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from marketgrain.operators.versions import cents, picture_key, version_history

SCHEMA = "snap_id long, generated_at timestamp_ntz, product_id string, new_price double, health_score int, image string"


def brute(rows):
    state: dict = {}
    by: dict = {}
    for snap, at, pid, price, score, image in rows:
        if pid is not None and at is not None:
            by.setdefault(pid, {}).setdefault(at.date(), []).append((at, snap, price, score, image))
    out = set()
    for pid, days in by.items():
        state, versions = (None, None, None), []
        for day in sorted(days):
            new = list(state)
            for _, _, *values in sorted(days[day], key=lambda r: r[:2]):
                for i, v in enumerate(values):
                    if v is not None:
                        new[i] = round(v * 100) if i == 0 else v
            if not versions or tuple(new) != state:
                versions.append((day, tuple(new)))
            state = tuple(new)
        for (a, s), (b, _) in zip(versions, [*versions[1:], (date(10000 - 1, 12, 31) + timedelta(0), None)], strict=True):
            out.add((pid, *[None if x is None else str(x) for x in s], a, b - timedelta(1) if b.year < 9999 else b))
    return out


def run(spark, rows):
    got = version_history(spark.createDataFrame(rows, SCHEMA)).select("product_id", "new_price", "health_score", "image", "version_from", "version_until").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_random(spark):
    r = random.Random(5)
    rows = []
    for n in range(2500):
        at = datetime(2024, 1, 1) + timedelta(days=r.randrange(150), hours=r.randrange(3))
        rows.append((n, at, r.choice(["hot", "hot", "b", "c", None]), r.choice([1.0, 1.5, None, 2.000000001]), r.choice([5, 6, None]), r.choice(["x", "y", None])))
    assert run(spark, rows) == brute(rows)


def test_returns_late_rows_and_nulls(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (3, t + timedelta(3), "p", 1.0, 5, None), (1, t, "p", 1.0, 5, None), (2, t + timedelta(1), "p", 2.0, None, None),
        (4, t + timedelta(3, hours=1), "p", None, 5, None), (5, None, "p", 9.0, 1, "z"), (6, t, "q", None, None, None), (7, t + timedelta(2), "q", None, 4, None),
    ]
    assert run(spark, rows) == brute(rows)
    assert len([x for x in run(spark, rows) if x[0] == "p"]) == 3


def test_more_than_64_days(spark):
    t = datetime(2024, 1, 1)
    rows = [(n, t + timedelta(n), "p", 1.0 if 60 <= n <= 140 else 2.0, 5, None) for n in range(200)]
    assert run(spark, rows) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", day date, entity string, a int, h long, bits long")
    assert version_history(df).collect() == []


def test_keys(spark):
    urls = ["https://A.example/p/1.webp?v=3", "http://a.example/p/1.webp", "//a.example/p/1.webp#t", " https://www.a.example/p/1.webp ", "", None, "https://a.example/P/1.webp"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(picture_key(F.col("u"))).collect()]
    assert got == ["a.example/p/1.webp"] * 4 + [None, None, "a.example/P/1.webp"]
    assert [r[0] for r in spark.createDataFrame([(5.990000001,), (6.0099995999,), (None,)], "p double").select(cents(F.col("p"))).collect()] == [599, 601, None]
