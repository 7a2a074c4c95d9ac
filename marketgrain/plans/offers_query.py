"""The interactive listing: filter, search, sort and page of an offer table as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.metrics import nutrient_metrics, reliable_unit_price
from marketgrain.operators.rank import page as page_of_rows
from marketgrain.operators.texts import search_text


def valid(name: str = "name", price: str = "new_price") -> Column:
    """A name that begins with a letter or digit, and a price."""
    return F.col(name).rlike(r"^[\p{L}\p{N}]") & F.col(price).isNotNull() & ~F.isnan(price)


def active_on(day: Column, first: str = "valid_from", last: str = "valid_until") -> Column:
    """Is the day within the offer's days, where a missing day leaves the end open?"""
    return (F.col(first).isNull() | (F.col(first) <= day)) & (F.col(last).isNull() | (F.col(last) >= day))


def in_stores(store: str, stores: str = "available_stores", own: str = "store") -> Column:
    """Is the store one of the row's stores, by default its own? Case and outer blanks do not count."""
    one = store.strip().lower()
    return F.exists(F.coalesce(F.col(stores), F.array(own)), lambda s: F.lower(F.trim(s)) == one)


def has_word(words: str, word: str) -> Column:
    """Is the word one of the blank-separated ones?"""
    return F.array_contains(F.split(F.col(words), r"\s+"), word)


def protein_for_money() -> Column:
    """Adjusted protein for a euro, 0 where it is not known."""
    unit = reliable_unit_price(F.col("price_per_kg"), F.col("new_price"), F.col("weight_grams"))
    return F.coalesce(nutrient_metrics("macros", unit)["adjusted_eur"], F.lit(0.0))


def sort_keys(sort: str) -> list[Column]:
    """Order of the listing; every order ends in ``ord``. Missing and zero unit prices come last; stores stand in Bulgarian
    order; ``history`` needs an array column ``price_history``."""
    healthy = F.when(F.coalesce("is_healthy", F.lit(False)), F.coalesce("health_score", F.lit(0))).otherwise(0)
    orders = {
        "recommended": lambda: [healthy.desc(), protein_for_money().desc(), F.col("new_price").asc_nulls_last()],
        "health": lambda: [healthy.desc(), F.col("new_price").asc_nulls_last()],
        "protein_value": lambda: [protein_for_money().desc()],
        "protein": lambda: [F.coalesce("macros.p", F.lit(0.0)).desc()],
        "price_asc": lambda: [F.coalesce("is_healthy", F.lit(False)).desc(), F.col("new_price").asc_nulls_last()],
        "price_per_kg": lambda: [F.coalesce("is_healthy", F.lit(False)).desc(), F.nullif("price_per_kg", F.lit(0.0)).asc_nulls_last()],
        "discount_desc": lambda: [F.coalesce("discount_pct", F.lit(0)).desc(), F.col("new_price").asc_nulls_last()],
        "store": lambda: [F.collate(F.lower(F.trim("store")), "bg").asc_nulls_last(), F.coalesce("discount_pct", F.lit(0)).desc()],
        "history": lambda: [F.coalesce(F.array_size("price_history"), F.lit(0)).desc(), F.coalesce("discount_pct", F.lit(0)).desc()],
        "valid_until": lambda: [F.col("valid_until").asc_nulls_last()],
    }
    return [*orders[sort](), F.col("ord").asc()]


def implied(sort: str, least_score: int = 6) -> Column | None:
    """The filter that an order brings along: by health only healthy rows of a score, by protein only healthy sources of it."""
    healthy = F.coalesce("is_healthy", F.lit(False))
    if sort == "health":
        return healthy & (F.coalesce("health_score", F.lit(0)) >= least_score)
    return healthy & F.coalesce("is_high_protein", F.lit(False)) if sort == "protein_value" else None


def offers_query(df: DataFrame, category: str | None = None, store: str | None = None, tag: str | None = None, search: str | None = None, sort: str = "recommended", page: int | None = None, page_size: int = 36, synonyms: Sequence[Sequence[str]] = (), day: str | None = None) -> DataFrame:
    """Rows of the listing under the given filters, in order; without ``page`` all of them.

    A store is one of the row's ``available_stores`` where there is that column, else its own. Some orders bring a filter along
    (:func:`implied`). ``search`` is looked for in name, store, category and tags with their synonyms, without regard to case and outer
    blanks; an empty search finds everything.
    """
    rows = df.where(valid())
    if day:
        rows = rows.where(active_on(F.to_date(F.lit(day))))
    if category:
        rows = rows.where(F.col("category") == category)
    if store:
        rows = rows.where(in_stores(store) if "available_stores" in df.columns else F.lower(F.trim("store")) == store.strip().lower())
    if (only := implied(sort)) is not None:
        rows = rows.where(only)
    if tag:
        rows = rows.where(F.array_contains("diet_tags", tag))
    if search and search.strip():
        text = search_text([F.col("name"), F.col("store"), F.col("category"), F.array_join("diet_tags", " ")], synonyms)
        rows = rows.where(F.contains(text, F.lit(search.strip().lower())))
    return rows.orderBy(*sort_keys(sort)) if page is None else page_of_rows(rows, sort_keys(sort), page, page_size)
