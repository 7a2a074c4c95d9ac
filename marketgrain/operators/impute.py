"""Filling missing values from similar records: K-prototypes clusters with parent fallback.

Rows are clustered on the features that are observed (numeric and categorical mixed); a missing value is filled with the
median or mode of the row's cluster, else of its parent group, else of all rows, and marked with the way it was filled.
Clustering covers all rows: every iteration is one pass in which each partition only sends sums per prototype.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.text import fold_lookalikes, plain
from marketgrain.session import cut

# Words and signs that stand for "no value".
NOTHING = ("null", "none", "nil", "nan", "na", "n/a", "n.a.", "unknown", "undefined", "няма", "неизв.", "неизв", "неизвестно", "неизвестна", "без категория", "не е посочено", "не е зададено", "unspecified", "uncategorized", "tbd", "?", "x", "xxx")
MACROS = ("kcal", "p", "f", "c")
_TOKENS = r"[^\p{L}]+"


def _tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(fold_lookalikes(plain(name)), _TOKENS), lambda t: F.length(t) >= 3))


def head_vocabulary(df: DataFrame, text: str, group: str, share: float = 2e-5, pure: float = 0.8, least: int = 3) -> list[tuple[str, int]]:
    """The words of ``text`` that tell the kind of item, most frequent first, with their number of distinct texts.

    At least ``pure`` of the texts with the word share one ``group``, and at least ``share`` of all uses of words (and ``least`` texts)
    are of it; rarer words are no kinds. So there are at most 1 / ``share`` words, whatever the size of the table. Counts
    cover all distinct texts.
    """
    texts = df.where(F.col(text).isNotNull() & F.col(group).isNotNull()).groupBy(text, group).count().select(text, group)
    by = texts.select(F.explode(_tokens(F.col(text))).alias("t"), F.col(group).alias("g")).groupBy("t", "g").agg(F.count("*").alias("n"))
    words = cut(by.groupBy("t").agg(F.sum("n").alias("n"), F.max("n").alias("most")))
    enough = max(float(least), share * (words.agg(F.sum("n").alias("n")).first()["n"] or 0))
    told = words.where((F.col("n") >= enough) & (F.col("most") >= pure * F.col("n")))
    return [(r["t"], r["n"]) for r in told.orderBy(F.desc("n"), "t").select("t", "n").collect()]  # at most 1 / share


def with_head(df: DataFrame, text: str, vocabulary: list[tuple[str, int]], out: str = "_head") -> DataFrame:
    """``df`` with the most frequent vocabulary word of ``text`` (null if it has none)."""
    if not vocabulary:
        return df.withColumn(out, F.lit(None).cast("string"))
    rank = {t: i for i, (t, _) in enumerate(vocabulary)}
    words = [t for t, _ in vocabulary]

    @F.pandas_udf("string")
    def head(tokens: pd.Series) -> pd.Series:
        def best(ts: np.ndarray | None) -> str | None:
            ranks = [rank[t] for t in ts if t in rank] if ts is not None else []
            return words[min(ranks)] if ranks else None

        return tokens.map(best)

    return df.withColumn(out, head(_tokens(F.col(text))))


def blank_value(c: Column) -> Column:
    """Is the text null, without letters, or one of the words for no value?"""
    t = plain(c)
    return c.isNull() | t.isin(*NOTHING) | ~t.rlike(r"\p{L}")


def stand_ins(df: DataFrame, value: str, group: str, most: float = 0.6, least: int = 10) -> DataFrame:
    """Values of ``value`` that are spread over the groups as if they said nothing: one column ``_v``, distinct.

    A true category lies mostly in one group; a stand-in of at least ``least`` rows has no group with ``most`` of them.
    """
    by = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("_v"), group).agg(F.count("*").alias("n"))
    return by.groupBy("_v").agg(F.sum("n").alias("n"), F.max("n").alias("m")).where((F.col("n") >= least) & (F.col("m") < most * F.col("n"))).select("_v")


def macros_given(macros: str = "macros") -> Column:
    """All four values are there and none is a negative stand-in (false, never null, also for a null struct)."""
    ok = F.lit(True)
    for k in MACROS:
        ok = ok & F.coalesce((F.col(f"{macros}.{k}") >= 0) & ~F.isnan(f"{macros}.{k}"), F.lit(False))
    return ok


def macros_zero(macros: str = "macros") -> Column:
    zero = F.lit(True)
    for k in MACROS:
        zero = zero & (F.coalesce(F.col(f"{macros}.{k}"), F.lit(-1.0)) == 0)
    return zero


def with_true_macros(headed: DataFrame, out: str = "_true", least: int = 5) -> DataFrame:
    """``headed`` (with ``_head``) with a flag: are the four values true ones?

    Four zeros are true only for kinds of item (by head word, at least ``least`` rows with values) that mostly have
    zeros, as water does; elsewhere they stand for missing values. There are at most as many
    kinds as words in the vocabulary (50 000 by its share), which bounds the table that is broadcast.
    """
    kinds = headed.where(macros_given() & F.col("_head").isNotNull()).groupBy("_head").agg(F.count("*").alias("_n"), F.sum(macros_zero().cast("int")).alias("_z"))
    zero = kinds.where((F.col("_n") >= least) & (F.col("_z") >= 0.5 * F.col("_n"))).select("_head", F.lit(True).alias("_zero_kind"))
    return headed.join(F.broadcast(zero), "_head", "left").withColumn(out, macros_given() & (~macros_zero() | F.coalesce(F.col("_zero_kind"), F.lit(False)))).drop("_zero_kind")


def discount_leads(old: str = "old_price", new: str = "new_price", discount: str = "discount_pct") -> Column:
    """Is there an old price from which the discount leads to the new one, to within rounding of both to hundredths?"""
    return F.coalesce((F.col(old) > 0) & (F.abs(F.col(old) * (1 - F.col(discount) / 100) - F.col(new)) <= 0.0101), F.lit(False))


# --- K-prototypes ---------------------------------------------------------------------------------------------------


class Prototypes:
    """Prototypes of mixed features: numeric centres (NaN where nothing is known) and categorical modes."""

    def __init__(self, centres: np.ndarray, modes: list[list[str | None]], gamma: list[float]) -> None:
        self.centres, self.modes, self.gamma = centres, modes, gamma

    def nearest(self, numbers: np.ndarray, categories: list[pd.Series]) -> np.ndarray:
        """Index of the nearest prototype of each row, over the features the row has (first of equals)."""
        n, k = len(numbers), len(self.centres)
        distance = np.zeros((n, k))
        for j in range(numbers.shape[1]):
            gap = (numbers[:, j, None] - self.centres[None, :, j]) ** 2
            distance += np.where(np.isnan(gap), 1.0, gap) * ~np.isnan(numbers[:, j, None])
        for j, column in enumerate(categories):
            codes, values = pd.factorize(column)
            at = {v: i for i, v in enumerate(values)}
            mode = np.array([at.get(m[j], -2) for m in self.modes])
            distance += self.gamma[j] * ((codes[:, None] != mode[None, :]) & (codes[:, None] >= 0))
        return distance.argmin(axis=1)


def fit_prototypes(rows: DataFrame, numeric: list[str], categorical: list[str], seeds: list[str], gamma: list[float], k: int = 96, rounds: int = 3) -> Prototypes | None:
    """K-prototypes over all rows of ``rows``; None for an empty table.

    The seeds are the ``k`` most frequent combinations of the ``seeds`` columns. A round is one pass: every row is assigned
    and partitions send, per prototype, sums of the numbers and counts of the categories; what comes to the driver is a
    row per prototype and feature. Rounds end when no prototype changes, at the latest after ``rounds``. ``gamma`` is the
    weight of a differing category, feature by feature.
    """
    c = len(categorical)
    top = rows.groupBy(*seeds).agg(F.count("*").alias("_n"), *[F.avg(x).alias(f"n{j}") for j, x in enumerate(numeric)]).orderBy(F.desc("_n"), *seeds).limit(k).collect()  # k rows
    if not top:
        return None
    nan = lambda v: np.nan if v is None else float(v)
    prototypes = Prototypes(np.array([[nan(r[f"n{j}"]) for j in range(len(numeric))] for r in top]), [[r[x] if x in seeds else None for x in categorical] for r in top], gamma)
    entries = [F.struct(F.lit(j).alias("j"), F.col(x).cast("string").alias("v"), F.lit(None).cast("double").alias("x")) for j, x in enumerate(categorical)]
    entries += [F.struct(F.lit(c + j).alias("j"), F.lit(None).cast("string").alias("v"), F.col(x).cast("double").alias("x")) for j, x in enumerate(numeric)]
    for _ in range(rounds):
        long = assign(rows, numeric, categorical, prototypes).select("_cluster", F.explode(F.array(*entries)).alias("e")).where("e.v IS NOT NULL OR e.x IS NOT NULL")
        counts = long.groupBy("_cluster", "e.j", "e.v").agg(F.count("*").alias("n"), F.avg("e.x").alias("x"))
        found = counts.groupBy("_cluster", "j").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("v"), F.max("x").alias("x")).collect()  # k x number of features
        centres, modes = prototypes.centres.copy(), [list(m) for m in prototypes.modes]
        for i in {r["_cluster"] for r in found}:
            centres[i], modes[i] = np.nan, [None] * c
        for r in found:
            if r["j"] < c:
                modes[r["_cluster"]][r["j"]] = r["v"]
            else:
                centres[r["_cluster"], r["j"] - c] = nan(r["x"])
        still = modes == prototypes.modes and np.allclose(centres, prototypes.centres, equal_nan=True)
        prototypes = Prototypes(centres, modes, gamma)
        if still:
            break
    return prototypes


def assign(rows: DataFrame, numeric: list[str], categorical: list[str], prototypes: Prototypes) -> DataFrame:
    """``rows`` with ``_cluster``, the index of the nearest prototype."""

    @F.pandas_udf("int")
    def cluster(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            numbers = np.column_stack([c.to_numpy(float) for c in columns[: len(numeric)]]) if numeric else np.zeros((len(columns[0]), 0))
            yield pd.Series(prototypes.nearest(numbers, list(columns[len(numeric) :])).astype("int32"))

    return rows.withColumn("_cluster", cluster(*[F.col(c).cast("double") for c in numeric], *[F.col(c).cast("string") for c in categorical]))


# --- the operator ---------------------------------------------------------------------------------------------------


def fill_offers(offers: DataFrame, k: int = 96, rounds: int = 3) -> DataFrame:
    """Missing ``category``, ``macros`` and ``old_price`` of offers with the values that fill them.

    One row per missing value: ``ord``, ``field``, ``filled`` (text: category; kcal/p/f/c; price) and ``method``
    (``cluster``, ``parent``, ``all``, for prices ``discount``, or ``none`` where nothing is known that could fill it). A value is
    missing when it is null, a stand-in, for macros not four true values of a food row, and for old prices of a discounted
    row when the discount does not lead from it to the new price. Medians are approximate (``percentile_approx`` of accuracy
    1000). An old price is the new one times the median ratio of discounted rows with the same discount in the cluster, the parent
    group or all, held within what the discount leads from; where no row has that discount it follows from it alone. Ties of modes go to the first value in text order. Rows repeated
    in full give the same values; an empty table gives no rows; columns beginning with an underscore are the operator's.
    """
    words = head_vocabulary(offers, "name", "emoji")
    discounted = F.coalesce(F.col("discount_pct") > 0, F.lit(False))
    headed = with_head(offers, "name", words).select(
        "ord", "new_price", "discount_pct", "category", F.struct(*[f"macros.{m}" for m in MACROS]).alias("macros"), "_head", F.col("emoji").alias("_parent"), F.coalesce("is_food", F.lit(False)).alias("_food"), blank_value(F.col("category")).alias("_blank"),
        (discounted & ~discount_leads()).alias("_no_old"), discounted.alias("_discounted"), (F.col("old_price") / F.nullif("new_price", F.lit(0.0))).alias("_ratio"),
        F.log10(F.when(F.col("new_price") > 0, F.col("new_price"))).alias("_price"), F.log10(F.when(F.col("weight_grams") > 0, F.col("weight_grams"))).alias("_weight"), (F.col("health_score") / 3).alias("_health"), plain(F.col("store")).alias("_store"),
        F.concat_ws("", *[F.col(c).cast("int").cast("string") for c in ("is_food", "is_healthy", "is_bulk_worthy", "is_long_lasting", "is_junk", "is_high_protein")]).alias("_flags"),
    )
    rows = with_true_macros(cut(headed))  # texts are read once, the rows are used in every round
    spread = stand_ins(offers, "category", "emoji").withColumn("_spread", F.lit(True))
    rows = rows.join(spread, F.col("category") == F.col("_v"), "left").drop("_v")
    no_category = F.col("_blank") | F.coalesce(F.col("_spread"), F.lit(False))
    rows = rows.withColumns({"_category": F.when(~no_category, F.col("category")), "_no_category": no_category, "_no_macros": F.col("_food") & ~F.col("_true")}).drop("category", "_blank", "_spread", "_food")
    rows = cut(rows)
    numeric, categorical = ["_price", "_weight", "_health"], ["_head", "_parent", "_category", "_flags", "_store"]
    prototypes = fit_prototypes(rows, numeric, categorical, ["_parent", "_head"], [2.0, 2.0, 1.0, 0.5, 0.2], k, rounds)
    rows = assign(rows, numeric, categorical, prototypes) if prototypes else rows.withColumn("_cluster", F.lit(0))
    rows = cut(rows.drop("_health", "_flags", "_store", "_weight", "_price", "_head"))

    def macro_stats(keys: list[str], out: str) -> DataFrame:
        values = F.concat_ws("/", *[F.format_string("%.1f", F.percentile_approx(f"macros.{m}", 0.5, 1000)) for m in MACROS])
        return rows.where("_true").groupBy(*keys).agg(F.when(F.count("*") > 0, values).alias(out))

    def category_stats(keys: list[str], out: str) -> DataFrame:
        counts = rows.where("_category IS NOT NULL").groupBy(*keys, "_category").agg(F.count("*").alias("n"))
        return counts.groupBy(*keys).agg(F.min_by("_category", F.struct(-F.col("n"), F.col("_category"))).alias(out))

    def price_stats(keys: list[str], out: str) -> DataFrame:
        ratio = F.percentile_approx("_ratio", 0.5, 1000)
        return rows.where(F.col("_discounted") & ~F.col("_no_old") & (F.col("new_price") > 0)).groupBy(*keys).agg(ratio.alias(out))

    def filled(missing: str, field: str, stats, levels: list[list[str]], value) -> DataFrame:
        # each table of statistics has a row per cluster, parent or discount: few rows, so that a hot one is no skew
        part = rows.where(missing).select("ord", "new_price", "discount_pct", "_cluster", "_parent").withColumn("_all", F.lit(1))
        for i, keys in enumerate(levels):
            table = stats(keys, f"_v{i}") if keys != ["_all"] else stats([], "_v" + str(i)).withColumn("_all", F.lit(1))
            part = part.join(table, keys, "left")
        found = value(F.coalesce(*[F.col(f"_v{i}") for i in range(len(levels))]))
        method = F.when(F.col("_v0").isNotNull(), "cluster").when(F.col("_v1").isNotNull(), "parent").when(F.col("_v2").isNotNull(), "all").when(F.col("filled").isNotNull(), "discount").otherwise("none")
        return part.select("*", found.alias("filled")).select("ord", F.lit(field).alias("field"), "filled", method.alias("method"))

    same = lambda c: c.cast("string")

    def price(ratio: Column) -> Column:
        left = F.when((F.col("discount_pct") > 0) & (F.col("discount_pct") < 100) & (F.col("new_price") > 0), 1 - F.col("discount_pct") / 100)
        low, high = (F.ceil((F.col("new_price") - 0.01) / left * 100) / 100), (F.floor((F.col("new_price") + 0.01) / left * 100) / 100)
        wanted = F.round(F.coalesce(ratio * F.col("new_price"), F.col("new_price") / left), 2)
        return F.when(left.isNotNull(), F.format_string("%.2f", F.least(F.greatest(wanted, low), high)))

    parts = [
        filled("_no_category", "category", category_stats, [["_cluster"], ["_parent"], ["_all"]], same),
        filled("_no_macros", "macros", macro_stats, [["_cluster"], ["_parent"], ["_all"]], same),
        filled("_no_old", "old_price", price_stats, [["_cluster", "discount_pct"], ["_parent", "discount_pct"], ["discount_pct"]], price),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out
