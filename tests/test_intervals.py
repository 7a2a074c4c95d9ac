"""Periods and gaps against day sets."""

from datetime import date, timedelta

from hypothesis import given
from hypothesis import strategies as st

from marketgrain.operators.intervals import SHIFT, TOP, _coalesce, periods_and_gaps

START = date(2024, 1, 1)


def brute(rows):
    """Per entity: runs of covered days and the holes between them, by sets of days."""
    days: dict = {}
    for entity, a, b in rows:
        if entity is not None and a is not None and b is not None and a <= b:
            days.setdefault(entity, set()).update(range(a.toordinal(), b.toordinal() + 1))
    out = set()
    for entity, have in days.items():
        have = sorted(have)
        first = have[0]
        for x, y in zip(have, [*have[1:], None], strict=True):
            if y != x + 1:
                out.add((entity, "period", date.fromordinal(first), date.fromordinal(x)))
                if y is not None:
                    out.add((entity, "gap", date.fromordinal(x + 1), date.fromordinal(y - 1)))
                first = y
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "id string, valid_from date, valid_until date")
    got = [tuple(r) for r in periods_and_gaps(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_cases(spark):
    d = lambda n: START + timedelta(n)
    rows = [
        ("a", d(0), d(4)), ("a", d(5), d(6)), ("a", d(9), d(9)), ("a", d(1), d(2)), ("a", d(0), d(4)),
        ("b", d(3), d(1)), ("c", None, d(1)), ("c", d(1), None), (None, d(0), d(3)), ("", d(0), d(0)),
        ("e", d(-4000), d(9000)), ("e", d(9002), d(9002)),
    ]
    assert run(spark, rows) == brute(rows)


def test_random(spark):
    import random

    r = random.Random(3)
    rows = []
    for _ in range(3000):
        a = r.randrange(400)
        rows.append((r.choice("xyzuvw") if r.random() > 0.3 else "hot", START + timedelta(a), START + timedelta(a + r.randrange(-2, 12))))
    assert run(spark, rows) == brute(rows)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], "id string, valid_from date, valid_until date, kind string, lv int, entity string, day_from int")
    assert periods_and_gaps(df).collect() == []
    one = spark.createDataFrame([("a", START, START, "k", 1, "e", 5)], df.schema)
    assert [tuple(r) for r in periods_and_gaps(one).collect()] == [("a", "period", START, START)]


def decompose(lo, hi):
    out, level = [], 0
    while lo < hi:
        if lo & 1:
            out.append((level, lo))
            lo += 1
        if hi & 1:
            hi -= 1
            out.append((level, hi))
        lo, hi, level = lo >> 1, hi >> 1, level + 1
    return out


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 90), st.integers(0, 20)), max_size=25), st.integers(1, 7))
def test_coalesce_across_batches(rows, size):
    """Blocks cut into batches at any place give the same periods."""
    import pandas as pd

    blocks = {(e, lv, ix) for e, a, n in rows for lv, ix in decompose(a + SHIFT, a + n + 1 + SHIFT)}
    assert all(lv <= TOP for _, lv, _ in blocks)
    table = pd.DataFrame(sorted(blocks, key=lambda b: (b[0], b[2] << b[1], -b[1])), columns=["entity", "lv", "ix"])
    parts = [table.iloc[i : i + size] for i in range(0, len(table), size)]
    got = {(r.entity, r.kind, r.d1, r.d2) for p in _coalesce(iter(parts)) for r in p.itertuples()}
    expected = {(e, k, (a - START).days, (b - START).days) for e, k, a, b in brute([(e, START + timedelta(a), START + timedelta(a + n)) for e, a, n in rows])}
    assert got == expected
