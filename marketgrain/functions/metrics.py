"""Derived values of offers: prices and discounts from each other, unit prices, ratios of nutrients, overlays of structs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leva of a euro.
RATE = 1.95583


def positive(c: Column) -> Column:
    """The number where it is above zero and one, else null."""
    return F.when((c > 0) & ~F.isnan(c), c)


def derived_old_price(old: Column, new: Column, discount: Column) -> Column:
    """The old price; where there is none and the discount is between 0 and 100, the price it leads from, in hundredths."""
    from_discount = F.when((discount > 0) & (discount < 100), F.floor(new / (1 - discount / 100) * 100 + 0.5) / 100)
    return F.coalesce(positive(old), from_discount)


def derived_discount(old: Column, new: Column, discount: Column) -> Column:
    """The whole percent by which the old price is above the new one, else the discount as it is."""
    return F.when(positive(old) > new, F.floor((1 - new / old) * 100 + 0.5).cast("int")).otherwise(discount)


def promotion_or_not(old: Column, discount: Column, yes: str = "promo", no: str = "assortment") -> Column:
    """``yes`` where there is an old price or a discount."""
    return F.when(F.coalesce((old > 0) | (discount > 0), F.lit(False)), yes).otherwise(no)


def reliable_unit_price(given: Column, price: Column, grams: Column, default_grams: float | None = None) -> Column:
    """Price per kilogram: the given one, else by price and content (or a default content), else null."""
    content = positive(grams.cast("double"))
    content = F.coalesce(content, F.lit(float(default_grams))) if default_grams else content
    return F.coalesce(positive(given), price / content * 1000)


def nutrient_metrics(macros: str, unit_price: Column, part: Column | None = None, quality: Column | None = None, rate: float = RATE) -> Column:
    """Struct (raw, purity, clean, adjusted, adjusted_eur) of protein for money; null below 1 g or without a unit price.

    ``raw`` grams for one unit of money, ``purity`` the protein's part of the nutrients, ``clean`` their product, ``adjusted``
    by the edible ``part`` and ``quality`` (1 where missing).
    """
    p, f, c = (F.col(f"{macros}.{k}") for k in "pfc")
    one = lambda x: F.lit(1.0) if x is None else F.coalesce(x, F.lit(1.0))
    raw = p * 10 / unit_price
    purity = p / (p + F.coalesce(f, F.lit(0.0)) + F.coalesce(c, F.lit(0.0)))
    clean = raw * purity
    adjusted = clean * one(part) * one(quality)
    return F.when((p >= 1) & (unit_price > 0), F.struct(raw.alias("raw"), purity.alias("purity"), clean.alias("clean"), adjusted.alias("adjusted"), (adjusted * rate).alias("adjusted_eur")))


def overlaid(base: str, other: str, fields: Sequence[str], prefer: Sequence[str] = (), fill: Sequence[str] = ()) -> Column:
    """Struct ``base`` overlaid with ``other``: all of it where base is null, else its ``prefer`` fields where it has them and
    its ``fill`` fields where base has none."""

    def value(k: str) -> Column:
        a, b = F.col(f"{base}.{k}"), F.col(f"{other}.{k}")
        return F.coalesce(b, a) if k in prefer else F.coalesce(a, b) if k in fill else a

    whole = F.struct(*[F.col(f"{other}.{k}").alias(k) for k in fields])
    return F.when(F.col(base).isNull(), F.when(F.col(other).isNotNull(), whole)).otherwise(F.struct(*[value(k).alias(k) for k in fields]))


def ruled(base: str, fields: Sequence[str], none: Column, rules: Sequence[tuple[Column, Mapping[str, float]]]) -> Column:
    """Struct ``base``: null where ``none`` holds, else with the values of the first rule that holds laid over it."""
    out = F.col(base)
    for holds, values in reversed(list(rules)):
        laid = F.struct(*[(F.lit(float(values[k])) if k in values else F.col(f"{base}.{k}")).alias(k) for k in fields])
        out = F.when(holds, laid).otherwise(out)
    return F.when(F.coalesce(none, F.lit(False)), F.lit(None)).otherwise(out)


def first_unless(text: Column, disqualified: Sequence[str], keywords: Sequence[tuple[str, Column | None]]) -> Column:
    """The first keyword that the text holds: null where a disqualifying word stands there, or where that keyword's own
    condition fails; no later keyword is tried then."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for word, condition in reversed(list(keywords)):
        out = F.when(F.contains(low, F.lit(word)), F.lit(word) if condition is None else F.when(condition, F.lit(word))).otherwise(out)
    for word in disqualified:
        out = F.when(F.contains(low, F.lit(word)), F.lit(None)).otherwise(out)
    return out


def in_language(values: Mapping[str, Column], language: str, order: Sequence[str]) -> Column:
    """The text in ``language``, else in the first language of ``order`` that has one; empty texts count as missing."""
    given = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(*[given(values[k]) for k in dict.fromkeys([language, *order])])


def filled(values: Mapping[str, Column], given: Mapping[str, Column]) -> dict[str, Column]:
    """Each of ``values`` where it is there, else what is ``given`` for it."""
    return {k: F.coalesce(c, given[k]) if k in given else c for k, c in values.items()}


def unreadable(name: Column, most_words: int = 12, least_letters: float = 0.4) -> Column:
    """Is a name garbage of text recognition: too many words, runs of signs, or too few letters?"""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    return F.coalesce((F.size(F.split(F.trim(name), r"\s+")) > most_words) | name.rlike(r"[^\p{L}\p{N}\s]{4,}") | (letters < least_letters * F.length(name)), F.lit(True))


def clean_name(name: Column) -> Column:
    """A name without leading numbering, repeated blanks and outer signs."""
    text = F.regexp_replace(F.regexp_replace(name, r"^\s*\d+[.)]\s*", ""), r"\s+", " ")
    return F.btrim(text, F.lit(" *.,/-"))


def translatable(text: Column, known: Column, letters: str = r"[Ѐ-ӿ]", least: int = 5) -> Column:
    """Is a text worth translating: it has such letters, is long enough and not known yet?"""
    return text.rlike(letters) & (F.length(F.trim(text)) > least) & ~F.coalesce(known, F.lit(False))


def within(bounds: Mapping[str, tuple[float, float]]) -> Column:
    """Do all the columns lie within their bounds? Missing ones do not."""
    ok = F.lit(True)
    for name, (low, high) in bounds.items():
        ok = ok & F.coalesce(F.col(name).between(low, high), F.lit(False))
    return ok


def merged(first: Column, second: Column) -> Column:
    """Union of two maps; of a key in both the second one's value counts."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(second), k))
    return F.when(first.isNull(), second).when(second.isNull(), first).otherwise(F.map_concat(kept, second))
