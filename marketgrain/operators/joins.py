"""Joins beyond plain equality, each without a product of rows."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from marketgrain.operators import closest
from marketgrain.operators.dedupe import keep_best
from marketgrain.session import cut

#: Parts in which the left rows of a group are compared with its right ones.
PARTS = 16
#: Texts of either side in one task of a fuzzy match; where they make few tasks, up to so many of at least so many pairs.
LEFT, RIGHT, TASKS, LEAST_PAIRS = 1 << 12, 1 << 17, 24, 1 << 22


def small(df: DataFrame, most_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most_rows`` rows, else unmarked (a shuffle join then).

    The count reads at most ``most_rows + 1`` rows.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def enrich(left: DataFrame, right: DataFrame, left_key: Column, right_key: str, take: Sequence[str] = (), prefer_right: dict[str, Column] | None = None) -> DataFrame:
    """Left join in which the left columns win, null or not; ``take`` adds right columns of other names.

    ``prefer_right`` names columns for which the right value is used where its condition holds (over ``l`` and ``r``).
    A right side with several rows of a key is not reduced here.
    """
    prefer_right = prefer_right or {}
    cols = [*dict.fromkeys([*take, *prefer_right])]
    r = right.select(F.col(right_key).alias("_rk"), *[F.col(c).alias(f"_r_{c}") for c in cols])
    joined = left.withColumn("_lk", left_key).join(r, F.col("_lk") == F.col("_rk"), "left")
    for c, use in prefer_right.items():
        joined = joined.withColumn(c, F.when(use, F.col(f"_r_{c}")).otherwise(F.col(c)))
    for c in take:
        joined = joined.withColumn(c, F.col(f"_r_{c}"))
    return joined.drop("_lk", "_rk", *[f"_r_{c}" for c in cols])


def upsert(stored: DataFrame, current: DataFrame, key: str, second: Sequence[Column]) -> DataFrame:
    """Current rows under the stored key they belong to, and the stored rows that nothing replaced.

    A current row replaces the stored row of its key, else the stored row whose ``second`` key (expressions over either
    side's columns) is the same. Both sides hold one row per key; of stored rows with one second key the first by key
    is meant. Nulls match nothing. Rows get ``change``: ``same``, ``moved``, ``new`` or ``kept``.
    """
    names = [f"_s{i}" for i in range(len(second))]
    with_second = lambda df: df.withColumns(dict(zip(names, second, strict=True)))
    s, c = with_second(stored), with_second(current)
    by_key = c.join(s.select(key), key, "left_semi").withColumn("change", F.lit("same"))
    rest = c.join(s.select(key), key, "left_anti")
    free = s.join(c.select(key), key, "left_anti").groupBy(*names).agg(F.min(key).alias("_stored_key"))
    moved = rest.join(free, names, "left").withColumn("change", F.when(F.col("_stored_key").isNotNull(), "moved").otherwise("new"))
    current_rows = by_key.withColumn("_stored_key", F.col(key)).unionByName(moved)
    kept = s.join(current_rows.select(F.col("_stored_key").alias(key)).where(F.col(key).isNotNull()), key, "left_anti").withColumn("change", F.lit("kept"))
    return current_rows.drop("_stored_key", *names).unionByName(kept.drop(*names), allowMissingColumns=True)


def band_join(left: DataFrame, right: DataFrame, on: Sequence[str], x: str, y: str, dx: float, dy: float, extra: Column | None = None) -> DataFrame:
    """Pairs of points with equal ``on`` and at most ``dx``, ``dy`` apart; right columns are prefixed ``r_``.

    The plane is cut into cells of dx by dy; left points go to the nine cells around theirs, so the join is an equality
    of cells with a residual, and a dense ``on`` group is spread over its cells. ``extra`` is a condition over both.
    """
    cell = lambda c, d: F.floor(F.col(c) / d)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    l = left.withColumn("_cx", F.explode(F.transform(around, lambda i: cell(x, dx) + i))).withColumn("_cy", F.explode(F.transform(around, lambda i: cell(y, dy) + i)))  # noqa: E741
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_rx", F.floor(F.col(f"r_{x}") / dx)).withColumn("_ry", F.floor(F.col(f"r_{y}") / dy))
    keys = (F.col("_cx") == F.col("_rx")) & (F.col("_cy") == F.col("_ry"))
    for c in on:
        keys = keys & (F.col(c) == F.col(f"r_{c}"))
    close = (F.abs(F.col(x) - F.col(f"r_{x}")) <= dx) & (F.abs(F.col(y) - F.col(f"r_{y}")) <= dy)
    out = l.join(r, keys & close)
    return (out.where(extra) if extra is not None else out).drop("_cx", "_cy", "_rx", "_ry")


def nearest_l1(left: DataFrame, right: DataFrame, on: Sequence[str], dims: Sequence[str], left_key: str, right_order: str, out: Sequence[str]) -> DataFrame:
    """Each left row with the ``out`` columns of its nearest right row of the same group, by the sum of absolute differences.

    Where the left row has no first dimension the first right row by ``right_order`` is taken. Ties go to it too. Right
    columns are prefixed ``r_``; left rows without a candidate keep nulls.
    """
    # a group is compared in parts of its left rows, each with all its right ones, so no pair becomes a row; NaN is far from all
    at = lambda c, far: F.when(F.isnan(F.col(c).cast("double")), F.lit(far)).otherwise(F.col(c).cast("double"))
    known = lambda df: df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in on))
    names = [f"_d{i}" for i in range(len(dims))]
    l = known(left).select(F.col(left_key).alias("_k"), *on, *[at(c, float("inf")).alias(n) for c, n in zip(dims, names, strict=True)], F.pmod(F.xxhash64(left_key), F.lit(PARTS)).alias("_part"))  # noqa: E741
    r = known(right).select(*on, *[at(c, float("-inf")).alias(n) for c, n in zip(dims, names, strict=True)], F.col(right_order).alias("_o"), *[F.col(c).alias(f"r_{c}") for c in out])
    r = r.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    flat = StructType([StructField("_k", left.schema[left_key].dataType), *[StructField(f"r_{c}", right.schema[c].dataType) for c in out]])

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({f.name: [] for f in flat})
        b = b.sort_values("_o", kind="stable", na_position="first")
        x, y = a[names].to_numpy("float64"), b[names].to_numpy("float64")
        best = np.zeros(len(a), np.int64)
        step = max(1, (1 << 22) // len(b))
        for i in range(0, len(a), step):
            gap = np.zeros((min(step, len(a) - i), len(b)))
            for k in range(len(names)):
                gap += np.nan_to_num(np.abs(x[i : i + step, k, None] - y[None, :, k]), nan=0.0, posinf=np.inf)
            gap[np.isnan(x[i : i + step, 0])] = 0.0
            best[i : i + step] = gap.argmin(axis=1)
        found = b.iloc[best][[f"r_{c}" for c in out]].reset_index(drop=True)
        found.insert(0, "_k", a["_k"].to_numpy())
        return found

    best = l.groupBy(*on, "_part").cogroup(r.groupBy(*on, "_part")).applyInPandas(nearest, flat)
    return left.join(best, left[left_key] == best["_k"], "left").select(left["*"], *[best[f"r_{c}"] for c in out])


def fuzzy_best(left: DataFrame, right: DataFrame, left_key: str, left_text: str, right_key: str, right_text: str, threshold: float = 0.3, block: int | None = None, parts: int | None = None) -> DataFrame:
    """Best right text of each left text: the larger of sequence ratio and word Jaccard, at least ``threshold``.

    The left side is a stated query set: its blocks of about ``block`` texts are each compared with all right texts, in
    ``parts``, and only the best match of a text leaves a task, so no pair becomes a row and none that reaches the threshold
    is lost (``closest.best``). Where they are not given, both follow from the numbers of texts. Ties go to the smallest right
    key; nulls match nothing. Result: ``left_key``, ``right_key``, ``score``.
    """
    l = cut(left.where(F.col(left_text).isNotNull()).select(F.col(left_key).alias("_l"), F.lower(left_text).alias("_t")))  # noqa: E741
    r = cut(right.where(F.col(right_text).isNotNull()).select(F.col(right_key).alias("_r"), F.lower(right_text).alias("_u")))
    n, m = l.count(), r.count()
    parts = parts or max(1, -(-m // RIGHT))
    blocks = max(1, -(-n // block) if block else max(-(-n // LEFT), min(TASKS, n * m // (parts * LEAST_PAIRS))))
    # by a stated number of partitions: small groups that are much work are not put together
    by = lambda df: df.repartition(blocks * parts, "_b", "_p").groupBy("_b", "_p")
    l = l.withColumn("_b", F.pmod(F.xxhash64("_t"), F.lit(blocks)).cast("int")).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))  # noqa: E741
    r = r.withColumn("_p", F.pmod(F.xxhash64("_u"), F.lit(parts)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    flat = StructType([StructField("_l", left.schema[left_key].dataType), StructField("_r", right.schema[right_key].dataType), StructField("score", DoubleType())])

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_r", kind="stable").drop_duplicates("_u")
        closest.one_thread()
        text, x = pd.factorize(a["_t"])
        score, at = closest.best(x.tolist(), b["_u"].tolist(), threshold)
        found = np.flatnonzero(at[text] >= 0)
        if not len(found):
            return pd.DataFrame({f.name: pd.Series([], dtype=float if f.name == "score" else object) for f in flat})
        return pd.DataFrame({"_l": a["_l"].to_numpy()[found], "_r": b["_r"].to_numpy()[at[text][found]], "score": score[text][found]})

    best = by(l).cogroup(by(r)).applyInPandas(match, flat)
    best = keep_best(best, ["_l"], [F.desc("score"), F.col("_r")])
    return best.select(F.col("_l").alias(left_key), F.col("_r").alias(right_key), "score")


def words(text: str) -> list[str]:
    """Words of three letters or more, as Jaccard compares them."""
    return [w for w in re.findall(r"\w+", text) if len(w) >= 3]


def by_two_keys(df: DataFrame, stored: DataFrame, first: Sequence[str], second: Sequence[str], order: str, take: Sequence[str]) -> DataFrame:
    """``take`` of the stored row found by the ``first`` key, else by the ``second``; of several the last in ``order`` counts."""

    def index(keys: Sequence[str], prefix: str) -> DataFrame:
        known = stored.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
        return known.groupBy(*keys).agg(F.max_by(F.struct(*take), F.col(order)).alias(prefix))

    rows = df.join(index(first, "_x"), [*first], "left").join(index(second, "_y"), [*second], "left")
    return rows.withColumns({c: F.coalesce(f"_x.{c}", f"_y.{c}") for c in take}).drop("_x", "_y")


def until_empty(pages: DataFrame, source: str, number: str, empty: Column) -> DataFrame:
    """Pages of each source with a number below that of its first ``empty`` one."""
    stops = pages.where(empty).groupBy(source).agg(F.min(number).alias("_stop"))
    return pages.join(stops, source, "left").where(F.col("_stop").isNull() | (F.col(number) < F.col("_stop"))).drop("_stop")


def on_spine(df: DataFrame, day: str, first: str, last: str, groups: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` on every day from ``first`` to ``last`` (ISO days); days without rows have nulls.

    With ``groups`` (distinct keys) each key gets every day.
    """
    days = df.sparkSession.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias(day))
    spine = days if groups is None else groups.distinct().crossJoin(F.broadcast(days))
    return spine.join(df, [day] if groups is None else [*groups.columns, day], "left")


def look_up(df: DataFrame, entries: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """``out``: the entry's value of ``key``, or the key itself where there is none (last entry by value wins)."""
    one = entries.groupBy(F.col(key).alias("_k")).agg(F.max(value).alias("_v"))
    return df.join(one, F.col(key) == F.col("_k"), "left").withColumn(out, F.coalesce("_v", key)).drop("_k", "_v")


def cache_probe(df: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` with what the cache holds for their key, and the distinct keys that the cache lacks."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return df.join(cache, key, "left"), keys.join(cache.select(key), key, "left_anti")


def share_first(df: DataFrame, group: str, value: str, usable: Column, order: Sequence[str]) -> DataFrame:
    """``value`` of each row: its own where usable, else the first usable one of its group in ``order``."""
    first = df.where(usable & F.col(group).isNotNull()).groupBy(F.col(group).alias("_g")).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return df.join(first, F.col(group) == F.col("_g"), "left").withColumn(value, F.when(usable, F.col(value)).otherwise(F.coalesce("_v", value))).drop("_g", "_v")


def best_per_group(df: DataFrame, key: str, member: str, order: Sequence[Column]) -> DataFrame:
    """Best row of each (key, member) pair among rows with a key, ranked within its key in ``order``."""
    best = keep_best(df.where(F.col(key).isNotNull()), [key, member], order)
    return best.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
