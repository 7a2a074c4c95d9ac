"""Core queries whose whole job no SQL asks for, against brute force."""

from marketgrain.plans import core_queries


def test_nearest_of_every_offer(spark, tmp_path):
    macros = [(1.0, 2.0, 3.0, "milk"), (9.0, 9.0, 9.0, None), (8.0, 9.0, 9.0, "oats"), (1.0, 2.0, 3.0, None), (-1.0, 0.0, 0.0, "x"), (8.0, 9.0, 9.0, "rye"), (5.0, 5.5, 6.0, None)]
    rows = [(i, "a" if i < 6 else "b", m) for i, m in enumerate(macros)] + [(7, "a", (4.5, 5.5, 6.0, None))]
    spark.createDataFrame(rows, "ord long, category string, macros struct<p: double, f: double, c: double, ingredients: string>").write.parquet(f"{tmp_path}/offers.parquet")
    got = {r["ord"]: r["nearest"] for r in core_queries.nearest_by_macros(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 2, 2: 2, 3: 0, 5: 2, 6: None, 7: 0}


def test_events_on_all_their_days(spark, tmp_path):
    from datetime import date, datetime

    rows = [(datetime(2023, 12, 30, 23), "a"), (datetime(2024, 1, 30, 1), "b"), (datetime(2024, 1, 30, 2), "b"), (None, "a")]
    events = spark.createDataFrame(rows, "ts timestamp, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r["event_type"], r["day"]): r["n"] for r in core_queries.events_on_every_day(spark, str(tmp_path)).collect()}
    assert len(got) == 64 and {k: n for k, n in got.items() if n} == {("a", date(2023, 12, 30)): 1, ("b", date(2024, 1, 30)): 2}
    events.limit(0).write.parquet(f"{tmp_path}/none/events.parquet")
    assert core_queries.events_on_every_day(spark, f"{tmp_path}/none").collect() == []


def test_brochures_with_missing_days(spark, tmp_path):
    from datetime import date

    rows = [("u1", "A", "x", date(2025, 3, 1), date(2025, 3, 31)), ("u2", "A", "y", None, None), ("u3", "B", "до 01.02.2025", None, None), ("u4", "B", "до 11.03.2025", None, None)]
    rows += [("u6", "C", "x", date(2024, 1, 1), date(2024, 1, 9)), ("u5", "C", "до 01.02.2024", None, None), ("u7", "D", "x", date(2025, 3, 11), None)]
    spark.createDataFrame(rows, "url string, store string, title string, valid_from date, valid_until date").write.parquet(f"{tmp_path}/brochures.parquet")
    got = {tuple(r) for r in core_queries.brochures_on_a_day(spark, str(tmp_path)).collect()}
    assert got == {("u1", "A", True), ("u2", "A", True), ("u4", "B", True), ("u5", "C", False), ("u7", "D", False)}
