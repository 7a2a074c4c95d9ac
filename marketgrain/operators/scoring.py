"""Additive rules, ranked profiles and completion of habits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def additive(df: DataFrame, profiles: Sequence[str], rules: Sequence[tuple[Column, dict[str, int]]]) -> DataFrame:
    """``df`` with one integer score per profile: the points of all rules whose condition holds (null is no)."""
    points = {p: sum((F.when(cond, F.lit(give[p])).otherwise(F.lit(0)) for cond, give in rules if p in give), F.lit(0)).cast("int") for p in profiles}
    return df.withColumns(points)


def ranked_profiles(profiles: Sequence[str]) -> Column:
    """Profiles as an array of (name, score), highest score first, ties in the order of ``profiles``."""
    items = F.array(*[F.struct((-F.col(p)).alias("s"), F.lit(i).alias("i"), F.lit(p).alias("name"), F.col(p).alias("score")) for i, p in enumerate(profiles)])
    return F.transform(F.array_sort(items), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score")))


def lowest_profile(profiles: Sequence[str]) -> Column:
    """Name of the profile with the least score, ties in the order of ``profiles``."""
    items = F.array(*[F.struct(F.col(p).alias("s"), F.lit(i).alias("i"), F.lit(p).alias("name")) for i, p in enumerate(profiles)])
    return F.array_min(items)["name"]


def banded(value: Column, bounds: Sequence[tuple[float, str]], above: str) -> Column:
    """Name of the first band whose upper bound (inclusive) holds the value, else ``above``; null for null."""
    out = F.lit(above)
    for bound, name in reversed(list(bounds)):
        out = F.when(value <= bound, F.lit(name)).otherwise(out)
    return F.when(value.isNotNull(), out)


def completion(df: DataFrame, keys: Sequence[str], done: Column, of: int) -> DataFrame:
    """Per key: number done, whole percent of ``of``, and whether it is full or partial."""
    by = df.groupBy(*keys).agg(F.count_if(done).alias("done"))
    return by.withColumns({"pct": F.floor(F.col("done") * 100 / of + 0.5).cast("int"), "full": F.col("done") >= of, "partial": (F.col("done") > 0) & (F.col("done") < of)})
