"""Ordered keyword rules as Column expressions, or as a table joined to the rows.

A keyword matches when the lower-cased text contains it. ``any_of`` asks whether one of the keywords matches,
``first_of`` gives the value of the first matching rule in order, ``longest_first`` sorts rules for it by length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, object]]


def any_of(text: Column, keywords: Sequence[str]) -> Column:
    """Does the text contain one of the keywords? False for a null text or no keywords."""
    if not keywords:
        return F.lit(False)
    words = F.array(*[F.lit(k.lower()) for k in keywords])
    return F.coalesce(F.exists(words, lambda k: F.contains(F.lower(text), k)), F.lit(False))


def first_of(text: Column, rules: Rules, default: object = None) -> Column:
    """Value of the first rule (keyword, value) that matches, else ``default``."""
    if not rules:
        return F.lit(default)
    table = F.array(*[F.struct(F.lit(k.lower()).alias("k"), F.lit(v).alias("v")) for k, v in rules])
    return F.coalesce(F.get(F.filter(table, lambda r: F.contains(F.lower(text), r["k"])), F.lit(0))["v"], F.lit(default))


def longest_first(rules: Rules) -> list[tuple[str, object]]:
    """Rules with the longest keyword first, equal lengths in their order."""
    return sorted(rules, key=lambda r: -len(r[0]))


def tags_of(text: Column, rules: dict[str, Sequence[str]], vetoes: dict[str, Sequence[str]] | None = None) -> Column:
    """Array of the tags whose keywords match and whose veto keywords do not, in the order of ``rules``."""
    vetoes = vetoes or {}
    found = [F.when(any_of(text, words) & ~any_of(text, vetoes.get(tag, ())), F.lit(tag)) for tag, words in rules.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def first_rule_join(df: DataFrame, text: str, rules: DataFrame, keyword: str, value: str, order: str, out: str, most_rules: int = 2000) -> DataFrame:
    """``df`` with ``out``: the value of the first rule of a rule table (by ``order``, then keyword) that matches.

    The rules are grouped into one array, at most ``most_rules`` of them (checked; more is an error), and attached to the
    rows, so that a row meets the rules without a product of rows in a shuffle. Nulls never match.
    """
    table = rules.where(F.col(keyword).isNotNull()).select(F.struct(F.col(order).alias("o"), F.lower(keyword).alias("k"), F.col(value).alias("v")).alias("r"))
    listed = table.agg(F.array_sort(F.collect_list("r")).alias("_rules"))
    if table.count() > most_rules:
        raise ValueError(f"more than {most_rules} rules; join them by words instead")
    hit = F.get(F.filter("_rules", lambda r: F.contains(F.lower(F.col(text)), r["k"])), F.lit(0))["v"]
    return df.crossJoin(F.broadcast(listed)).withColumn(out, hit).drop("_rules")
