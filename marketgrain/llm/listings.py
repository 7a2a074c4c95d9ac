"""Listings of the same product: multi-pass sorted neighbourhood, soft token alignment, correlation clustering.

Every listing becomes one record: the tokens of its name in one alphabet, its content of a piece and number of pieces.
Nothing about the tokens is fixed but an optional bilingual glossary; the rest is counted over all listings: slips (rare
words one edit from far more frequent ones), wording (words that say nothing about the content) and which words of one
alphabet stand where the other alphabet has which (listings that share their rarest common word and content). Records of
one wording are compared once. Several token orders are sorted, neighbours within a window are compared by an alignment
of their tokens that allows slips and counterparts, and the pairs, alike or not, are the positive and negative edges of a
correlation clustering by pivots, which runs in rounds over tables in the checkpoint folder.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.functions.measure import stated
from marketgrain.llm.glyphs import ordinary_spelling
from marketgrain.llm.parse import GLOSSARY, Glossary, name_tokens, near
from marketgrain.session import cut, shuffle_width

#: Neighbours compared on either side in a sorted order.
WINDOW = 24
#: Rows of a sorted order that one task compares at a time.
BLOCK = 4096
#: How many times as frequent, over all listings, the word is of which another one is a slip.
SLIP_RATIO = 5
#: A word of at least so many listings is wording when two listings that hold it have the same content no more often
#: than this many times as often as any two listings.
WORDING_USES, WORDING_RATIO = 20, 1.35
#: How many times as frequent one of two words must be for the other to be taken for its slip in an alignment, if that is used
#: more than once.
SOFT_RATIO = 3
#: Blocks in which two words must meet before one counts as a counterpart, and least weight beside the best one.
MEETINGS, COUNTERPART = 2, 0.15
#: Least mean alignment of two names, and least alignment of the worst token in the better of the two directions.
LEAST_ALIGNED, LEAST_WORST = 0.65, 0.45


def listing_records(offers: DataFrame, key: str = "id", glossary: Glossary = GLOSSARY) -> DataFrame:
    """One record (``id``, ``content``, ``form``, ``tokens``) per listing: what most of its rows say, by name in ordinary
    spelling and by ``weight_raw``. ``form`` stands for content and wording."""
    rows = offers.where(F.col(key).isNotNull()).groupBy(key, "name", "weight_raw").agg(F.count("*").alias("n"))
    rows = rows.select(F.struct(F.col(key).alias("id"), "weight_raw", "n").alias("k"), "name")
    plain = ordinary_spelling(rows, "k", "name").select("k.id", "k.n", "spelled", stated(F.col("spelled")).alias("by_name"), stated(F.col("k.weight_raw")).alias("by_weight"))
    most = lambda value, given: F.max_by(value, F.struct(F.when(given, F.col("n")), F.hash(value)))
    # rows of one spelling count together, whatever their weight_raw
    one = plain.withColumn("n", F.sum("n").over(Window.partitionBy("id", "spelled"))).groupBy("id").agg(
        F.max_by("spelled", F.struct("n", "spelled")).alias("spelled"),
        most(F.struct("by_name.each", "by_name.pieces"), F.col("by_name.each").isNotNull()).alias("c1"),
        most(F.struct("by_weight.each", "by_weight.pieces"), F.col("by_weight.each").isNotNull()).alias("c2"),
        most(F.col("by_name.count"), F.col("by_name.count").isNotNull()).alias("k1"),
        most(F.col("by_weight.count"), F.col("by_weight.count").isNotNull()).alias("k2"),
    )

    @F.pandas_udf("wording string, tokens array<string>")
    def read(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([name_tokens(x, glossary) for x in names], columns=["wording", "tokens"])

    content = F.when(F.col("c1.each").isNotNull(), F.col("c1")).otherwise(F.col("c2"))
    one = one.select("id", read("spelled").alias("r"), content.alias("c"), F.coalesce("k1", "k2").alias("items"))
    said = F.when(F.col("c.each").isNotNull(), F.concat_ws("x", F.col("c.pieces").cast("string"), F.round("c.each").cast("long").cast("string")))
    one = one.select("id", said.alias("said"), "items", "r.wording", "r.tokens")
    one = one.withColumn("content", F.coalesce("said", F.concat(F.col("items").cast("string"), F.lit("pc")), F.lit("")))
    return one.select("id", "content", F.xxhash64("content", "wording", F.array_sort("tokens")).alias("form"), "tokens")


# --- what the words of all listings tell ------------------------------------------------------------------------------


def _variants(word: Column) -> Column:
    """The word and, from five letters on, the word with each of its letters left out: words one slip apart share one."""
    out = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) >= 5, out).otherwise(F.array().cast("array<string>"))))


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([near(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def word_slips(words: DataFrame, ratio: float = SLIP_RATIO) -> DataFrame:
    """(``w``, ``meant``): words of ``words`` (``w``, ``n``) one slip from another one ``ratio`` times as frequent.

    Of several the most frequent is meant. Where that is a slip itself, what it stands for is meant; the frequency
    rises with every such step, so they are few.
    """
    spread = words.where((F.length("w") >= 5) & ~F.col("w").rlike("^[0-9=]")).select("w", "n").withColumn("v", F.explode(_variants(F.col("w"))))
    close = spread.alias("a").join(spread.alias("b"), (F.col("a.v") == F.col("b.v")) & (F.col("b.n") >= ratio * F.col("a.n")) & (F.col("a.w") != F.col("b.w")))
    pairs = close.select(F.col("a.w").alias("w"), F.col("b.w").alias("meant"), F.col("b.n").alias("n")).distinct().where(_near("w", "meant"))
    slips = cut(pairs.groupBy("w").agg(F.max_by("meant", F.struct("n", "meant")).alias("meant")))
    while True:
        further = slips.select(F.col("w").alias("meant"), F.col("meant").alias("_further"))
        if slips.join(further, "meant", "left_semi").isEmpty():
            return slips
        slips = cut(slips.join(further, "meant", "left").select("w", F.coalesce("_further", "meant").alias("meant")))


def word_statistics(uses: DataFrame) -> DataFrame:
    """One row per word of ``uses`` (``w``, ``sign``, ``content``, ``n`` listings): ``n``, ``both`` (written in two alphabets),
    ``wording`` (says nothing about the content)."""
    by = uses.groupBy("w", "content").agg(F.sum("n").alias("k"), F.bool_or(F.col("sign") == "c").alias("c"), F.bool_or(F.col("sign") == "l").alias("l"))
    alike = F.sum(F.col("k") * (F.col("k") - 1)) / F.nullif(F.sum("k") * (F.sum("k") - 1), F.lit(0)).cast("double")
    words = by.groupBy("w").agg(F.sum("k").alias("n"), alike.alias("alike"), (F.bool_or("c") & F.bool_or("l")).alias("both"))
    totals = uses.select("form", "content", "n").distinct().groupBy("content").agg(F.sum("n").alias("k"))
    any_two = totals.agg(alike.alias("a")).first()["a"] or 0.0
    said = F.col("w").rlike("^[0-9=]") | (F.length("w") < 2) | F.col("both")
    return words.select("w", "n", "both", (~said & (F.col("n") >= WORDING_USES) & (F.coalesce("alike", F.lit(1.0)) < WORDING_RATIO * any_two)).alias("wording"))


def counterparts(forms: DataFrame) -> DataFrame:
    """(``w``, ``meets`` array of (``w``, ``weight`` up to 1)): words of the other alphabet that stand where ``w`` stands.

    ``forms`` has ``form``, ``content`` and ``tokens`` (w, sign, n, both). The rarest word that is written in both alphabets ties
    forms of one content together; within such a block each word of one side is linked to the word of the other side with
    which it is most correlated over all blocks, and the links, counted over all blocks (Dice), are the weights. A block counts as two
    sets of words, never as pairs of its listings; words met only once in a block of two sides are no evidence.
    """
    tokens = forms.select("form", "content", F.filter("tokens", lambda t: ~t["w"].startswith("=")).alias("t"))
    tied = tokens.withColumn("tie", F.array_min(F.transform(F.filter("t", lambda t: t["both"]), lambda t: F.struct(t["n"], t["w"])))["w"]).where("tie IS NOT NULL")
    ties = tied.groupBy("tie").agg(F.count("*").alias("times"))
    one = lambda sign: F.size(F.filter("t", lambda t: ~t["both"] & (t["sign"] == sign)))
    side = F.when(one("l") > one("c"), "l").when(one("c") > 0, "c")
    bags = tied.select("content", "tie", side.alias("side"), F.explode(F.filter("t", lambda t: t["w"] != F.col("tie"))).alias("t")).where("side IS NOT NULL")
    # a word that mostly ties is a name and has no counterpart but itself
    names = bags.select("t.w", "t.n").distinct().join(ties, F.col("w") == F.col("tie")).where("2 * times > n").select("w")
    bags = bags.select("content", "tie", "side", "t.w").distinct().join(names, "w", "left_anti")
    bags = cut(bags)
    sides = bags.groupBy("content", "tie").agg(F.count_distinct("side").alias("s")).where("s = 2").select("content", "tie")
    bags = bags.join(sides, ["content", "tie"], "left_semi")
    blocks = bags.groupBy("side", "w").agg(F.count("*").alias("b")).where(F.col("b") >= MEETINGS)
    bags = bags.join(blocks, ["side", "w"])
    block = F.xxhash64("content", "tie").alias("block")
    left = bags.where("side = 'l'").select(block, F.col("w").alias("l"), F.col("b").alias("lb"))
    right = bags.where("side = 'c'").select(block, F.col("w").alias("c"), F.col("b").alias("cb"))
    met = cut(left.join(right, "block"))
    dice = lambda count: 2 * count / (F.col("lb") + F.col("cb"))
    n = F.lit(float(sides.count()))
    more = n * F.col("k") - F.col("lb") * F.col("cb")  # than by chance; the correlation of both words over the blocks
    phi = more / F.sqrt(F.col("lb") * F.col("cb") * F.greatest(n - F.col("lb"), F.lit(1.0)) * F.greatest(n - F.col("cb"), F.lit(1.0)))
    weights = met.groupBy("l", "c", "lb", "cb").agg(F.count("*").alias("k")).where((F.col("k") >= MEETINGS) & (more > 0)).select("l", "c", phi.alias("d"))
    best = met.join(weights, ["l", "c"]).withColumns({"ld": F.max("d").over(Window.partitionBy("block", "l")), "cd": F.max("d").over(Window.partitionBy("block", "c"))})
    links = ((F.col("d") >= F.col("ld")).cast("int") + (F.col("d") >= F.col("cd")).cast("int")) / 2
    linked = cut(best.groupBy("l", "c", "lb", "cb").agg(F.sum(links).alias("k")).where("k > 0").select("l", "c", dice(F.col("k")).alias("d")))
    both = linked.select(F.col("l").alias("w"), F.col("c").alias("o"), "d").union(linked.select(F.col("c").alias("w"), F.col("l").alias("o"), "d"))
    both = both.where(~(F.col("w").rlike("^[0-9]") & F.col("o").rlike("^[0-9]") & (F.col("w") != F.col("o"))))  # two numbers never mean the same
    scaled = both.withColumn("weight", F.col("d") / F.max("d").over(Window.partitionBy("w"))).where((F.col("weight") >= COUNTERPART) & (F.col("w") != F.col("o")))
    scaled = scaled.groupBy("w", "o").agg(F.max("weight").alias("weight"))
    return scaled.groupBy("w").agg(F.sort_array(F.collect_list(F.struct(F.col("o").alias("w"), "weight"))).alias("meets"))


# --- comparison -----------------------------------------------------------------------------------------------------


#: The tokens of a name: how many listings hold each, and the weights of its counterparts.
Tokens = dict[str, tuple[int, dict[str, float]]]


def _partner(w: str, o: str, x: Tokens, y: Tokens) -> float:
    """How well token ``o`` of ``y`` stands for token ``w`` of ``x``."""
    (n, meets), (m, others) = x[w], y[o]
    best = max(meets.get(o, 0.0), others.get(w, 0.0))
    if len(w) >= 5 and abs(len(w) - len(o)) <= 1 and (n >= SOFT_RATIO * m or m >= SOFT_RATIO * n or min(n, m) == 1) and near(w, o):
        best = max(best, 0.75)
    if best < 0.9 and meets and others:  # two words of one alphabet with the same counterparts
        dot = sum(v * others.get(k, 0.0) for k, v in meets.items())
        best = max(best, 0.9 * dot / (sum(v * v for v in meets.values()) * sum(v * v for v in others.values())) ** 0.5)
    return best


def _explained(x: Tokens, y: Tokens) -> tuple[float, float]:
    """How well the tokens of ``x`` are found in ``y``: on average, and the worst one."""
    total = weight = 0.0
    worst = 1.0
    left = [o for o in y if o not in x and o[0] != "="]
    for w in x:
        e = 1.0 if w in y else 0.0 if w[0] == "=" else max((_partner(w, o, x, y) for o in left), default=0.0)
        own = 1.0 if len(w) > 1 else 0.5
        total += own * e
        weight += own
        if len(w) > 1:
            worst = min(worst, e)
    return (total / weight if weight else 1.0), worst


def soft_alignment(x: Tokens, y: Tokens) -> float:
    """Alignment of two names: 1 for equal ones.

    The mean, over both directions, of how well tokens find a partner: itself 1, a slip of a word of five letters 0.75 (where
    one of the two is SOFT_RATIO times as frequent or stands only there), a counterpart its weight. Where in both directions a token has hardly
    any partner, the names contradict: 0.
    """
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    (a, p), (b, q) = _explained(x, y), _explained(y, x)
    return (a + b) / 2 if max(p, q) >= LEAST_WORST else 0.0


def sorted_neighbours(rows: DataFrame, compare, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, score) of ``sig`` among neighbours in the sorted orders of ``rows``.

    ``rows`` has ``pass``, ``group``, ``order``, ``sig`` and a ``body``; only rows of one pass and group are compared.
    ``compare(body)`` turns a body into a function of another body, giving a score or None for no pair. All passes are one
    range partitioning; rows get their position in it, and blocks of positions, each with the first ``window`` rows of
    the next, are compared one by one, so no block is larger than ``block + window`` rows, whatever is hot.
    """
    spark = rows.sparkSession
    order = ["pass", "group", "order", "sig"]
    placed = rows.select(*order, "body").repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order)
    placed = cut(placed.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_i")))
    start, at = {}, 0
    for r in sorted(placed.groupBy("_p").agg(F.count("*").alias("n")).collect()):  # a row per partition
        start[r["_p"]] = at
        at += r["n"]
    if not at:
        return spark.createDataFrame([], "a long, b long, score double")
    first = F.element_at(F.create_map(*[F.lit(x) for p in start.items() for x in p]), F.col("_p"))
    placed = placed.select("pass", "group", "sig", "body", (first + F.col("_i")).alias("_at"))
    own = F.floor(F.col("_at") / block)
    copies = F.when((F.col("_at") % block < window) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    placed = placed.withColumn("_block", F.explode(copies))

    def neighbours(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        inside = int((part["_at"] < (int(part["_block"].iloc[0]) + 1) * block).sum())
        sig, group, step = part["sig"].to_numpy(), part["group"].to_numpy(), part["pass"].to_numpy()
        bodies = [compare(b) for b in part["body"]]
        a, b, score = [], [], []
        for i in range(inside):
            for j in range(i + 1, min(i + 1 + window, len(bodies))):
                if group[j] != group[i] or step[j] != step[i]:
                    break
                if (found := bodies[i](bodies[j])) is not None:
                    a.append(min(sig[i], sig[j]))
                    b.append(max(sig[i], sig[j]))
                    score.append(found)
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64"), "score": pd.Series(score, dtype="float64")})

    pairs = placed.groupBy("_block").applyInPandas(neighbours, "a long, b long, score double")
    return pairs.groupBy("a", "b").agg(F.max("score").alias("score"))


class Name:
    """The tokens of a form with their counterparts; called with another one it gives their alignment.

    Names of which neither holds one of the two rarest words of the other, nor a slip or counterpart of the rarest, are no
    pair (None); tokens of a glossary are no words here, unless there is nothing else.
    """

    def __init__(self, body) -> None:
        self.tokens: Tokens = {t["w"]: (t["n"], {m["w"]: m["weight"] for m in t["meets"]} if t["meets"] is not None else {}) for t in body}

        own = [w for w in self.tokens if w[0] != "="] or list(self.tokens)
        self.leads = sorted(own, key=lambda w: (self.tokens[w][0], w))[:2]

    def __call__(self, other: Name) -> float | None:
        x, y = self.tokens, other.tokens
        if not x or not y:
            return 1.0 if not x and not y else None
        if not any(w in y for w in self.leads) and not any(w in x for w in other.leads) and _partner(self.leads[0], other.leads[0], x, y) < LEAST_WORST:
            return None
        return soft_alignment(x, y)


def token_orders(forms: DataFrame) -> DataFrame:
    """The sorted orders of all forms in one table: rarest token first, most frequent first, by letters, and the rarest
    one turned round; a word and its counterpart are one word in them. Only forms of one content are neighbours."""
    plain = lambda t: F.when(F.coalesce(F.size(t["meets"]), F.lit(0)) > 0, F.least(t["w"], F.array_min(F.transform(t["meets"], lambda m: F.struct((-m["weight"]).alias("x"), m["w"].alias("w"))))["w"])).otherwise(t["w"])
    ranked = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(t["n"].alias("n"), plain(t).alias("w")))), lambda x: x["w"])
    rows = forms.select("form", "content", F.transform("tokens", lambda t: F.struct(t["w"].alias("w"), t["n"].alias("n"), t["meets"].alias("meets"))).alias("body"), ranked.alias("r"))
    turned = F.concat(F.transform(F.slice("r", 1, 1), lambda w: F.reverse(w)), F.expr("slice(r, 2, greatest(size(r) - 1, 1))"))
    join = lambda words: F.array_join(words, " ")
    orders = F.array(join("r"), join(F.reverse("r")), join(F.array_sort("r")), join(turned))
    return rows.select(F.col("form").alias("sig"), F.col("content").alias("group"), "body", F.posexplode(orders).alias("pass", "order"))


# --- clustering -----------------------------------------------------------------------------------------------------


def pivot_clusters(edges: DataFrame) -> DataFrame:
    """Clusters (sig, cluster) of the nodes of positive ``edges`` (a, b); all other pairs are negative.

    Parallel pivots: a node whose hash is the least among its open neighbours takes its open neighbours, of several
    pivots the least; taken nodes leave, and the next round begins. The expected number of rounds is logarithmic.
    """
    h = lambda c: F.xxhash64(F.lit(11), c)
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut(both)
    done = None
    while not both.isEmpty():
        least = both.groupBy("a").agg(F.min(F.struct(h("b").alias("h"), F.col("b").alias("b"))).alias("m"))
        pivots = least.where(F.struct(h("a").alias("h"), F.col("a").alias("b")) < F.col("m")).select("a")
        joined = both.join(pivots, "a").groupBy("b").agg(F.min(F.struct(h("a").alias("h"), F.col("a").alias("c"))).alias("m")).select(F.col("b").alias("sig"), F.col("m.c").alias("cluster"))
        now = cut(joined.unionByName(pivots.select(F.col("a").alias("sig"), F.col("a").alias("cluster"))))
        done = now if done is None else done.unionByName(now)
        both = cut(both.join(now.select(F.col("sig").alias("a")), "a", "left_anti").join(now.select(F.col("sig").alias("b")), "b", "left_anti").select("a", "b"))
    return done if done is not None else edges.select(F.col("a").alias("sig"), F.col("a").alias("cluster")).limit(0)


def _improved(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """``clusters`` after each node has moved to the cluster with which it agrees most (positive less negative edges),
    where that is more than with its own; ties stay."""
    to = clusters.select(F.col("sig").alias("b"), "cluster")
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "plus", "minus"))
    net = both.join(to, "b").groupBy("a", "cluster").agg(F.sum(F.col("plus") - F.col("minus")).alias("net"))
    own = clusters.select(F.col("sig").alias("a"), F.col("cluster").alias("own"))
    best = net.join(own, "a").groupBy("a", "own").agg(F.max(F.struct("net", (F.col("cluster") == F.col("own")).alias("stays"), "cluster")).alias("m"), F.max(F.when(F.col("cluster") == F.col("own"), F.col("net"))).alias("now"))
    moves = best.where((F.col("m.net") > 0) & (F.col("m.net") > F.coalesce("now", F.lit(0)))).select(F.col("a").alias("sig"), F.col("m.cluster").alias("_to"))
    return cut(clusters.join(moves, "sig", "left").select("sig", F.coalesce("_to", "cluster").alias("cluster")))


def correlation_clusters(pairs: DataFrame) -> DataFrame:
    """Clusters (sig, cluster) from compared ``pairs`` (a, b, plus, minus), each pair once.

    Clusters by pivots are improved by one move of each node to the cluster it agrees with most, then contracted to single nodes, the edges between two of them added up, and those with more
    positive than negative ones clustered again, until no such edge is left. A run of equal keys longer than the window
    is a band of edges; it is joined so, in a logarithmic number of rounds. Nodes without a positive edge are not listed.
    """
    pairs = cut(pairs)
    clusters = None
    while True:
        found = pivot_clusters(pairs.where("plus > minus"))
        found = cut(found)
        if found.isEmpty():
            return clusters if clusters is not None else found
        if clusters is None:
            clusters = found = _improved(pairs, found)
        else:
            clusters = cut(clusters.join(found.select(F.col("sig").alias("cluster"), F.col("cluster").alias("_to")), "cluster", "full").select(F.coalesce("sig", "cluster").alias("sig"), F.coalesce("_to", "cluster").alias("cluster")))
        to = lambda side: found.select(F.col("sig").alias(side), F.col("cluster").alias(f"_{side}"))
        moved = pairs.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "plus", "minus").where("a <> b")
        pairs = cut(moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("plus").alias("plus"), F.sum("minus").alias("minus")))


# --- the operator -----------------------------------------------------------------------------------------------------


def prepared_forms(records: DataFrame) -> DataFrame:
    """The distinct wordings of ``records``: ``form``, ``content``, ``tokens`` (w, n, meets) without slips and wording."""
    forms = records.groupBy("form").agg(F.first("content").alias("content"), F.first("tokens").alias("tokens"), F.count("*").alias("n"))
    raw = forms.select("form", "content", "n", F.explode_outer("tokens").alias("t"))
    sign = F.when(F.col("t").startswith("="), "=").otherwise(F.substring("t", 1, 1))
    raw = cut(raw.select("form", "content", "n", F.when(F.col("t").startswith("="), F.col("t")).otherwise(F.expr("substring(t, 2)")).alias("w"), sign.alias("sign")))
    slips = word_slips(raw.where("w IS NOT NULL").groupBy("w").agg(F.sum("n").alias("n")))
    uses = raw.join(slips, "w", "left").withColumn("w", F.coalesce("meant", "w")).drop("meant")
    words = cut(word_statistics(uses.where("w IS NOT NULL")))
    kept = uses.join(words.withColumnRenamed("n", "_n"), "w", "left")
    token = F.when(F.col("w").isNotNull(), F.struct("w", "sign", F.col("_n").alias("n"), "both", "wording"))
    forms = kept.groupBy("form").agg(F.first("content").alias("content"), F.sort_array(F.collect_set(token)).alias("tokens"))
    # wording goes where anything else is left that is not a word of both alphabets, as names of makers are
    telling = F.exists("tokens", lambda t: ~t["wording"] & ~t["both"])
    forms = cut(forms.withColumn("tokens", F.when(telling, F.filter("tokens", lambda t: ~t["wording"])).otherwise(F.col("tokens"))))
    meets = counterparts(forms)
    out = forms.select("form", "content", F.explode_outer("tokens").alias("t")).select("form", "content", "t.w", "t.n").join(meets, "w", "left")
    return cut(out.groupBy("form").agg(F.first("content").alias("content"), F.sort_array(F.collect_set(F.when(F.col("w").isNotNull(), F.struct("w", "n", "meets")))).alias("tokens")))


def compared_forms(forms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Pairs (a, b, score) of forms that were neighbours in one of the orders and have something in common."""
    return sorted_neighbours(token_orders(forms), Name, window)


def product_groups(offers: DataFrame, key: str = "id", glossary: Glossary = GLOSSARY) -> DataFrame:
    """One row (``key``, ``product``) per listing; listings of one product share ``product``.

    ``glossary`` may be :data:`NO_GLOSSARY`: what words mean is then only learnt from the listings. Rows without a listing
    key are ignored; a listing without a name, or with an empty one, is grouped by what its weight says only with
    listings that say no more. Of several spellings of a listing the most frequent counts, ties by text order. An empty
    table gives an empty result; other columns do not matter.
    """
    records = cut(listing_records(offers, key, glossary))
    pairs = compared_forms(prepared_forms(records))
    alike = F.col("score") >= LEAST_ALIGNED
    clusters = correlation_clusters(pairs.select("a", "b", alike.cast("int").alias("plus"), (~alike).cast("int").alias("minus")))
    named = records.select(F.col("id").alias(key), "form").join(clusters, F.col("form") == F.col("sig"), "left")
    return named.select(key, F.coalesce("cluster", "form").alias("product"))


def same_product_pairs(groups: DataFrame, key: str = "id") -> DataFrame:
    """All pairs (``id_a`` < ``id_b``) of listings of one product; repeated keys give one pair."""
    a = groups.select(F.col("product"), F.col(key).alias("id_a")).distinct()
    b = groups.select(F.col("product"), F.col(key).alias("id_b")).distinct()
    return a.join(b, "product").where("id_a < id_b").select("id_a", "id_b")
