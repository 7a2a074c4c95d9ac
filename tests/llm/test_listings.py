"""Product groups against truth made with the listings, and the parts of the method."""

import random
from itertools import combinations

from hypothesis import given
from hypothesis import strategies as st

from marketgrain.llm.listings import Name, compared_forms, correlation_clusters, listing_records, pivot_clusters, prepared_forms, product_groups, same_product_pairs, soft_alignment, sorted_neighbours
from marketgrain.llm.parse import NO_GLOSSARY, latin, name_tokens, near

SCHEMA = "ord long, id string, name string, weight_raw string"
FOODS = [("yogurt 3.6", ["Кисело мляко 3,6%", "К. мляко 3.6 % масл.", "Yogurt 3.6%", "Kiselo mlyako 3,6% fat"]), ("yogurt 2", ["Кисело мляко 2%", "Yogurt 2%"]), ("lentils", ["Леща червена", "Lentils red"]), ("eggs", ["Яйца клас S", "Eggs size S"]), ("cheese", ["Бяло саламурено сирене от краве мляко", "White cheese cow", "Sirene cow milk"])]
SIZES = [((400, 1), ["400 г", "0,4 кг", "0.4kg"]), ((400, 2), ["2 х 400 г", "400g × 2"]), ((500, 1), ["половин килограм", "500 gr", "0,500 кг"]), ((454, 1), ["16 oz", "1 lb", "454 г"])]
MAKERS = [("Рекарна", "Rekarna"), ("Гипегли", "GIPEGLI"), ("Falerdi", "„Фалерди“")]


def catalogue(n=260, seed=4):
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        m, (food, ways), (size, says) = r.randrange(3), *(r.choice(x) for x in (FOODS, SIZES))
        parts = [r.choice(MAKERS[m]), r.choice(ways), r.choice(says)]
        r.shuffle(parts)
        name = r.choice(["", "Промо: ", "само с карта "]) + " ".join(parts) + r.choice(["", " НОВО!", " best price"])
        rows.append((i, f"s{i}", name, None if i % 2 else r.choice(says)))
        truth[f"s{i}"] = (m, food, size)
    return rows, truth


def test_groups_and_pairs(spark):
    rows, truth = catalogue()
    groups = product_groups(spark.createDataFrame(rows, SCHEMA))
    got = {(r["id_a"], r["id_b"]) for r in same_product_pairs(groups).collect()}
    assert got == {(a, b) for a, b in combinations(sorted(truth), 2) if truth[a] == truth[b]}


def test_edges(spark):
    assert product_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, "a", None, None), (2, "b", "", None), (3, None, "x", None), (4, "c", "Рекарна Леща червена", "400 г"), (5, "c", "Рекарна Леща червена", "400 г"), (6, "d", "Леща Rekarna червна 400 г", None), (7, "e", "дума " * 20000, None)]
    got = {r["id"]: r["product"] for r in product_groups(spark.createDataFrame(rows, SCHEMA + ", product string, sig long, n int").withColumnsRenamed({}) if False else spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"} and got["c"] == got["d"] and got["e"] != got["c"]


def test_neighbours_reach_over_blocks(spark):
    """Every pair within the window is compared, whatever the block, but none of two groups or passes."""

    class Number:
        def __init__(self, body):
            pass

        def __call__(self, other):
            return 1.0

    df = spark.range(300).selectExpr("id as sig", "id div 200 as group", "0 as pass", "format_string('%03d', id) as `order`", "id as body")
    rows = sorted_neighbours(df, Number, 6, 16).collect()
    got = {(r["a"], r["b"]) for r in rows}
    assert got == {(a, b) for a in range(300) for b in range(a + 1, min(300, a + 7)) if a // 200 == b // 200} and len(rows) == len(got)
    assert sorted_neighbours(df.limit(0), Number).collect() == []


def test_pivot_clusters(spark):
    edges = [(1, 2), (2, 3), (1, 3), (10, 11), (11, 12), (20, 20)]
    got = {r["sig"]: r["cluster"] for r in pivot_clusters(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got) == {1, 2, 3, 10, 11, 12} and got[1] == got[2] == got[3]
    assert len({got[10], got[11], got[12]}) <= 2
    assert pivot_clusters(spark.createDataFrame([], "a long, b long")).collect() == []


def test_correlation_clusters(spark):
    """A long band of edges becomes one cluster; two cliques with one stray edge and many negative ones stay apart."""
    band = [(i, i + d, 1, 0) for i in range(60) for d in (1, 2) if i + d < 60]
    cliques = [(a, b, 1, 0) for base in (100, 110) for a, b in combinations(range(base, base + 4), 2)]
    across = [(a, b, int((a, b) == (100, 110)), int((a, b) != (100, 110))) for a in range(100, 104) for b in range(110, 114)]
    got = {r["sig"]: r["cluster"] for r in correlation_clusters(spark.createDataFrame([*band, *cliques, *across], "a long, b long, plus int, minus int")).collect()}
    assert len({got[i] for i in range(60)}) == 1
    assert len({got[i] for i in range(100, 104)}) == 1 and got[100] != got[110] and got[110] == got[113]
    assert correlation_clusters(spark.createDataFrame([], "a long, b long, plus int, minus int")).collect() == []


@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_near_is_edit_distance(a, b):
    def distance(x, y):
        d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(y) + 1)] for i in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (x[i - 1] != y[j - 1]))
                if i > 1 and j > 1 and x[i - 1] == y[j - 2] and x[i - 2] == y[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    assert near(a, b) == (distance(a, b) <= 1)


def test_reading():
    a, b = name_tokens("само с карта Сирене бло саламурено козе „Gezaglik“ 0,5 кг НОВО!")[1], name_tokens("Goat white cheese GEZAGLIK 500 g")[1]
    assert a == b == ["=white_cheese", "=goat", "lgezaglik"]
    assert latin("Фалерди") == "falerdi" and name_tokens(None) == name_tokens("") == ("", [])
    assert name_tokens("Сладко от боровинки Дерони 360 г", NO_GLOSSARY)[1] == ["csladko", "cot", "cborovinki", "cderoni"]


def test_alignment():
    of = lambda *words: {w: (1 if w == "kashkval" else 5, {}) for w in words}
    assert soft_alignment(of("kashkaval", "rekarna"), of("kashkval", "rekarna")) == 0.875
    assert soft_alignment(of("kashkaval", "rekarna"), of("kashkavan", "rekarna")) == 0.0  # as frequent: two words
    assert soft_alignment({}, {}) == 1.0 and soft_alignment({}, of("a")) == 0.0
    assert soft_alignment(of("leshta", "red", "rekarna"), of("leshta", "green", "rekarna")) == 0.0  # they contradict
    assert soft_alignment({"leshta": (3, {"lentils": 1.0}), "rekarna": (5, {})}, of("lentils", "rekarna")) == 1.0
    assert Name([])(Name([])) == 1.0 and Name([{"w": "a", "n": 1, "meets": None}])(Name([])) is None


# foods of no list: two ways to write each, in either alphabet, with invented words
ODD_FOODS = [("slad borov", ["Сладко боровинка", "Blueberry jam"]), ("slad kays", ["Сладко кайсия", "Apricot jam"]), ("lyut", ["Лютеница фина", "Smooth lyutenitsa"]), ("hum", ["Хумус класик", "Hummus classic"]), ("hum2", ["Хумус чушка", "Hummus paprika"]), ("chips", ["Чипс морска", "Crisps sea"]), ("tar", ["Тархана домашна", "Trahana homemade"]), ("buk", ["Булгур едър", "Bulgur big"])]


def odd_catalogue(products=400, seed=9):
    """Products of 50 makers, each sold in a few listings in either alphabet."""
    r = random.Random(seed)
    latin_makers = sorted({"".join(r.choice("bdgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(50)})
    makers = [(m.translate(str.maketrans("abdegiklmnoprstuvz", "абдегиклмнопрстувз")).title(), m.title()) for m in latin_makers]
    rows, truth = [], {}
    for m, f, size in {(r.randrange(len(makers)), r.randrange(len(ODD_FOODS)), r.choice(["360 г", "500 g", "200 г", "1 kg", "250 г", "750 g"])) for _ in range(products)}:
        for _ in range(r.randint(1, 6)):
            name = [r.choice(makers[m]), r.choice(ODD_FOODS[f][1]), size]
            r.shuffle(name)
            i = len(rows)
            rows.append((i, f"s{i}", " ".join(name), None))
            truth[f"s{i}"] = (m, f, size)
    return rows, truth


def test_foods_of_no_list(spark):
    """Without a glossary, and with one that knows none of these foods, counterparts are learnt from the listings."""
    rows, truth = odd_catalogue()
    want = {(a, b) for a, b in combinations(sorted(truth), 2) if truth[a] == truth[b]}
    got = {(r["id_a"], r["id_b"]) for r in same_product_pairs(product_groups(spark.createDataFrame(rows, SCHEMA), glossary=NO_GLOSSARY)).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)
    got = {(r["id_a"], r["id_b"]) for r in same_product_pairs(product_groups(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert len(got & want) >= 0.95 * len(want) and len(got & want) >= 0.95 * len(got)


def test_window_reaches_nearly_all(spark):
    """Alike pairs found within the window against those found by comparing all forms of one content."""
    rows, _ = catalogue(400, 6)
    forms = prepared_forms(listing_records(spark.createDataFrame(rows, SCHEMA)))
    alike = lambda w: {(r["a"], r["b"]) for r in compared_forms(forms, w).where("score >= 0.65").collect()}
    everything, windowed = alike(100000), alike(24)
    assert windowed <= everything and len(windowed) >= 0.99 * len(everything) > 0


def test_slips_of_makers(spark):
    """Slips are told by frequency over all products: in a small product, in several listings of a hot one, in the first letter."""
    names = ["Рекарна Леща червена 400 г"] * 12 + ["Рекарна Яйца клас S 10 бр"] * 2 + ["Екарна Леща червена 400 г", "Ekarna Lentils red 400 g", "Рекарно Яйца клас S 10 бр"]
    names += ["Фалерди Леща червена 400 г"] * 4 + ["Фалерда Леща червена 400 г"] * 2  # as frequent: two makers
    rows = [(i, f"s{i:02}", n, None) for i, n in enumerate(names)]
    got = {r["id"]: r["product"] for r in product_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {got[f"s{i:02}"] for i in [*range(12), 14, 15]} == {got["s00"]} and got["s12"] == got["s13"] == got["s16"]
    assert len(set(got.values())) == 4 and got["s17"] != got["s21"]


def test_slips_far_apart_in_a_hot_maker(spark):
    """Records without a known food, beyond any window of one maker and content, find their partner."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("bdgklmnprstvz") + r.choice("aeiou") for _ in range(4))
    rows = []
    for i in range(60):
        words = [word() for _ in range(4)]
        for k, x in enumerate((words, [*words[:3], "q" + words[3][1:]])):
            rows.append((2 * i + k, f"s{i}-{k}", " ".join(["Velikomakerski", *x, "400 g"]), None))
    got = {x["id"]: x["product"] for x in product_groups(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[f"s{i}-0"] == got[f"s{i}-1"] for i in range(60)) and len(set(got.values())) == 60
