"""Leaked items against an alignment of words, on texts with planted passages."""

import random

import pytest

from marketgrain.llm import leakage
from marketgrain.llm.leakage import leaked_items

WORDS = [f"{a}{b}{c}" for a in ("ka", "mo", "ri", "te", "sul") for b in ("ra", "ne", "lo", "vi") for c in ("", "m", "st", "n", "ko", "rda")]


def texts(n, length, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(WORDS) for _ in range(length)) for _ in range(n)]


def test_planted(spark):
    r = random.Random(9)
    items = texts(12, 44, 1)
    docs, truth = [], set()
    for n in range(240):
        body = texts(1, r.randrange(5, 120), 100 + n)[0].split()
        kind = n % 6
        k = n % len(items)
        words = items[k].split()
        if kind == 0:
            piece, hit = words, True
        elif kind == 1:
            a = r.randrange(0, 15)
            piece, hit = words[a : a + 27], True
        elif kind == 2:
            a = r.randrange(0, 20)
            piece, hit = words[a : a + 18], False  # less than half
        elif kind == 3:
            piece, hit = [w if i % 11 != 5 else "zzzzz" for i, w in enumerate(words)], True
        elif kind == 4:
            piece, hit = words[:15] + texts(1, 30, n)[0].split() + words[15:30], False  # broken
        else:
            piece, hit = [], False
        at = r.randrange(len(body) + 1)
        text = " ".join(body[:at] + piece + body[at:])
        if kind == 0:
            text = text.upper().replace(" ", "\n", 3).replace("A", "А")  # a Cyrillic letter of the same shape
        docs.append((n, text))
        if hit:
            truth.add((k, n))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["item_id"], x["doc_id"]) for x in leaked_items(d, i).collect()}
    assert got == truth


def test_han_and_character_forms(spark):
    item = "合作社向全体社员通报了淀粉与干蛋白各占一半份额，尽管秤在前一天下午才校准过。在仓库的检查中记录到钙含量是原料的两倍之多。"
    docs = [(1, "今天天气很好。" + item[10:50] + "我们走吧。"), (2, "今天天气很好。" + item[10:24] + "我们走吧。"), (3, item.replace("，", "​ ")), (4, item[:20])]
    got = {x["doc_id"] for x in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1, 3}


def test_edges(spark, monkeypatch):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (3, "short")], "doc_id long, text string")
    i = spark.createDataFrame([(1, None), (2, ""), (3, "a")], "item_id long, text string")
    assert leaked_items(d, i).collect() == []
    assert leaked_items(d.limit(0), i.limit(0)).collect() == []
    long = " ".join(texts(1, 20000, 3))
    piece = " ".join(long.split()[9000:9044])
    got = leaked_items(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string"), spark.createDataFrame([(5, piece)], "item_id long, text string")).collect()
    assert [(r["item_id"], r["doc_id"], r["share"]) for r in got] == [(5, 1, 1.0)]
    monkeypatch.setattr(leakage, "MOST_ITEMS", 2)
    with pytest.raises(ValueError):
        leaked_items(d, spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "item_id long, text string"))


def test_changed_words_in_partial_leaks(spark):
    """Words changed near the ends of a stretch just over half, with other lengths or in a text without blanks."""
    r = random.Random(3)
    items = texts(8, 44, 71)
    docs, truth = [], set()
    for n in range(96):
        k, kind = n % len(items), n // 8 % 4
        a = r.randrange(0, 20)
        piece = items[k].split()[a : a + 24]
        for at in ((2, 21), (2, 3), (2, 12, 21), (2, 3, 10, 11, 20, 21))[kind]:
            piece[at] = r.choice(["zzzzz", "xyxyxyxyxy", "qq"]) if kind else "zzzzz"[: len(piece[at])].ljust(len(piece[at]), "z")
        if kind < 3:
            truth.add((k, n))
        body = texts(1, 60, 500 + n)[0].split()
        docs.append((n, " ".join(body[:30]) + " " + ("" if kind == 0 and n % 3 == 0 else " ").join(piece) + " " + " ".join(body[30:])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x["item_id"], x["doc_id"]) for x in leaked_items(d, i).collect()}
    assert got == truth


def test_items_shorter_than_a_gram(spark):
    """Items of a word or a few characters are found whole, and in half."""
    items = spark.createDataFrame([(1, "Skyr"), (2, "买牛奶"), (4, "!"), (5, "мляко сирене")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Plain SKYR, 150 g"), (2, "我去买牛奶。"), (3, "Skyrs and skyrocket"), (4, "a b"), (5, "Прясно мляко"), (6, "")], "doc_id long, text string")
    assert {(r["item_id"], r["doc_id"]) for r in leaked_items(docs, items).collect()} == {(1, 1), (1, 3), (2, 2), (5, 5)}  # blanks do not count, so a word may go on


def test_recall_within_the_budget(spark):
    """Every k-th word changed, to words as long or longer, at all lengths of items."""
    import random

    r = random.Random(3)
    word = lambda n: "".join(r.choice("abcdefghiklmnopr") for _ in range(n))
    items, docs = [], []
    for n in (1, 3, 10, 40, 120, 240):
        for k, longer in ((0, 0), (12, 0), (7, 0), (12, 8)):
            i = len(items)
            own = [word(r.randint(3, 9)) for _ in range(n)]
            items.append((i, " ".join(own)))
            docs.append((i, " ".join([*(word(6) for _ in range(20)), *(word(len(w) + longer).upper() if k and j % k == k // 2 else w for j, w in enumerate(own)), *(word(6) for _ in range(20))])))
    got = {(x["item_id"], x["doc_id"]) for x in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    whole = {(i, i) for i, x in items if len(x.split()) > 1 or docs[i][1].find(x) >= 0}
    assert whole <= got and sum(a != b for a, b in got) <= 3
