"""The most alike texts: whole and exact against plain difflib, and without scoring every pair."""

import difflib
import random
import time

import pytest

from marketgrain.operators import closest, joins


def brute(x, y, threshold):
    def score(a, b):
        p, q = set(joins.words(a)), set(joins.words(b))
        return max(difflib.SequenceMatcher(None, a, b).ratio(), len(p & q) / len(p | q) if p and q else 0.0)

    best = [min(((-score(t, u), j) for j, u in enumerate(y)), default=(9, 0)) for t in x]
    return [(-s, j) if -s >= threshold else (0.0, -1) for s, j in best]


def names(r, n):
    some = ["".join(r.choice("abdegikлмнорстуя") for _ in range(r.randint(3, 9))) for _ in range(400)]
    return sorted({" ".join(r.sample(some, 5)) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_best_is_brute_force(monkeypatch, seed):
    r = random.Random(seed)
    if seed % 2:  # many tiles, blocks and passes
        for name, value in {"TILE": 7, "ROWS": 3, "PAIRS": 64, "HELD": 40, "TABLE": 1 << 12}.items():
            monkeypatch.setattr(closest, name, value)
    for letters in ("ab", "abcde ", "abcdefghijбвг  ", "".join(chr(0x4E00 + k) for k in range(300)) + " " * 60):
        for most in (3, 40, 90):
            text = lambda m: "".join(r.choice(letters) for _ in range(r.randint(0, m)))  # noqa: B023, E731
            x = sorted({text(most) for _ in range(15)} | {"", "a\0bcd x", "日本語", "x" * r.choice([63, 64, 65, 128, 129, 300])})
            y = sorted({text(most) for _ in range(40)} | {"", "日本", "xyz", "bcd a", text(260), "xxx abc"})
            for threshold in (0.0, 0.3, 0.75):
                score, at = closest.best(x, y, threshold)
                assert list(zip(score.tolist(), at.tolist(), strict=True)) == brute(x, y, threshold)
    assert closest.best([], ["a"], 0.3)[1].tolist() == [] and closest.best(["a", ""], [], 0.3)[1].tolist() == [-1, -1]


def test_few_pairs_are_scored(monkeypatch):
    r = random.Random(8)
    x, y, scored = names(r, 60), names(r, 4000), []
    ratio = closest.Search.ratio
    monkeypatch.setattr(closest.Search, "ratio", lambda self, i, j: scored.append(len(i)) or ratio(self, i, j))
    score, at = closest.best(x, y, 0.3)
    assert sum(scored) < len(x) * len(y) / 50
    assert list(zip(score.tolist()[:5], at.tolist()[:5], strict=True)) == brute(x[:5], y, 0.3)


def test_fuzzy_best_of_many_names_ends(spark):
    r = random.Random(9)
    x, y = names(r, 300), names(r, 9000)
    left, right = spark.createDataFrame([(t,) for t in x], "a string"), spark.createDataFrame([(t,) for t in y], "b string")
    began = time.time()
    got = {row["a"]: (row["score"], y.index(row["b"])) for row in joins.fuzzy_best(left, right, "a", "a", "b", "b").collect()}
    assert time.time() - began < 75  # scored pair by pair, it had not ended after 80 s
    assert len(got) == len(x) and [got[t] for t in x[::100]] == brute(x[::100], y, 0.3)
