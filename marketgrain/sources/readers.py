"""Readers. Every one adds ``ord``, the arrival number, as rows in Spark have no order of their own.

Nothing here goes to the network: a reader takes files, or a table of fetched pages (``url``, ``html``).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.functions.scalars import date_range, parse_date, parse_price

PRICE_FILE = T.StructType([T.StructField(n, T.StringType()) for n in ("store_id", "store_name", "name", "code", "category", "regular", "promo")])


def with_order(df: DataFrame) -> DataFrame:
    """``ord``: file by file in path order, within a file in line order; unique, not without gaps."""
    return df.withColumn("ord", F.monotonically_increasing_id())


def price_file(spark: SparkSession, path: str, promos_only: bool = False) -> DataFrame:
    """Price file (comma, UTF-8 with or without BOM): rows with a numeric first column, a name and a price above 0.

    ``price`` is the promotional price if there is one, else the regular one; ``old_price`` the regular one where the
    promotional price is below it. Header lines, short lines and unreadable prices drop out.
    """
    rows = with_order(spark.read.csv(path, schema=PRICE_FILE, mode="PERMISSIVE", encoding="UTF-8", multiLine=False))
    first = F.regexp_replace("store_id", "^\\ufeff", "")
    money = lambda c: F.regexp_replace(F.trim(c), ",", ".").try_cast("decimal(10,2)")
    rows = rows.withColumns({"regular": money("regular"), "promo": money("promo"), "store_id": F.trim(first)})
    price = F.coalesce(F.when(F.col("promo") > 0, F.col("promo")), F.col("regular"))
    rows = rows.where(F.col("store_id").try_cast("double").isNotNull() & (F.trim("name") != "")).withColumn("price", price).where("price > 0")
    rows = rows.withColumn("old_price", F.when((F.col("promo") > 0) & (F.col("promo") < F.col("regular")), F.col("regular")))
    if promos_only:
        rows = rows.where("promo > 0")
    return rows.select("ord", "store_id", "store_name", F.trim("name").alias("name"), F.nullif(F.trim("code"), F.lit("")).alias("code"), "category", "price", "old_price")


class _Cards(HTMLParser):
    """Collects the elements with a class, and in them the texts of elements by class."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, card: str, fields: dict[str, str]) -> None:
        super().__init__(convert_charrefs=True)
        self.card, self.fields = card, fields
        self.rows: list[dict[str, list[str]]] = []
        self.depth, self.inside = 0, -1
        self.open: list[tuple[int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if self.inside < 0 and self.card in classes:
            self.inside = self.depth
            self.rows.append({f: [] for f in self.fields})
        if self.inside >= 0:
            row = self.rows[-1]
            for f, where in self.fields.items():
                name, _, attribute = where.partition("@")
                if attribute and (not name or name in classes or name == tag) and attribute in a:
                    row[f].append(a[attribute])
                elif not attribute and name in classes:
                    row[f].append("")
                    self.open.append((self.depth, f))
        if tag not in self.VOID:
            self.depth += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in self.VOID:
            return
        self.depth -= 1
        self.open = [(d, f) for d, f in self.open if d < self.depth]
        if self.inside >= 0 and self.depth <= self.inside:
            self.inside, self.open = -1, []

    def handle_data(self, data: str) -> None:
        for _, f in self.open:
            self.rows[-1][f][-1] += data


def html_cards(pages: DataFrame, card: str, fields: dict[str, str], url: str = "url", html: str = "html") -> DataFrame:
    """One row per element of class ``card`` of each page: ``url``, ``place``, and an array of texts per field.

    A field is given by a class ("price"), or by a class or tag and an attribute ("img@src", "@data-json"). Broken markup
    gives what can be read of it; null pages give nothing.
    """
    names = list(fields)
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("place", T.IntegerType()), *[T.StructField(n, T.ArrayType(T.StringType())) for n in names]])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for u, text in zip(batch[url], batch[html], strict=True):
                if isinstance(text, str):
                    parser = _Cards(card, fields)
                    parser.feed(text)
                    parser.close()
                    out += [(u, i, *[[" ".join(x.split()) for x in row[n]] for n in names]) for i, row in enumerate(parser.rows)]
            yield pd.DataFrame(out, columns=["url", "place", *names])

    return pages.select(url, html).mapInPandas(read, schema)


def decoded(content: Column, fallback: str = "windows-1251") -> Column:
    """Text of bytes: UTF-8, or the fallback encoding where they are no valid UTF-8 (Spark decodes Unicode and Latin
    encodings only, so the fallback is an Arrow batch UDF; it sees only the rows that need it).
    """

    @F.pandas_udf(T.StringType())
    def other(parts: pd.Series) -> pd.Series:
        return parts.map(lambda b: None if b is None else bytes(b).decode(fallback, "replace"))

    good = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(F.when(good, content.cast("string")), other(F.when(~good, content)))


def paired_prices(texts: Column) -> Column:
    """Of price texts that come in pairs (two currencies) every second one, as decimals."""
    return F.transform(F.filter(texts, lambda x, i: i % 2 == 1), parse_price)


def attribute_json(pages: DataFrame, attribute: str, schema: str, html: str = "html", encoded: bool = False) -> DataFrame:
    """Rows of the JSON objects that stand in an attribute of the pages' elements: ``place`` and the schema's fields.

    Entities are resolved, or percent escapes where ``encoded``. What is no JSON gives null fields.
    """
    from marketgrain.functions.scalars import html_unescape

    found = F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rf"{re.escape(attribute)}=(?:\"([^\"]*)\"|'([^']*)')"), F.lit(0))).alias("place", "a")
    rows = pages.select(*[c for c in pages.columns if c != html], found)
    value = F.regexp_replace("a", rf"^{re.escape(attribute)}=[\"']|[\"']$", "")
    text = F.try_url_decode(value) if encoded else html_unescape(value)
    return rows.withColumn("_j", F.from_json(text, schema)).select(*[c for c in rows.columns if c != "a"], "_j.*")


def json_ld_products(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Products described by JSON-LD: ``url``, ``name``, ``image``, ``price`` and ``valid_until``.

    ``offers`` may be an object or a list (its first entry counts), ``image`` a string or a list. Without a price there
    the page's price text is used, without a picture its og:image.
    """
    block = F.explode_outer(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"), F.lit(1))).alias("j")
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("_html"), block)
    rows = rows.where(F.coalesce(F.get_json_object("j", "$.@type"), F.lit("Product")) == "Product")
    get = lambda p: F.get_json_object("j", p)
    image = F.coalesce(F.get_json_object("j", "$.image[0]"), F.when(~get("$.image").startswith("["), get("$.image")), F.nullif(F.regexp_extract("_html", r'(?i)property="og:image"[^>]*content="([^"]*)"', 1), F.lit("")))
    price = F.coalesce(get("$.offers.price"), get("$.offers[0].price")).try_cast("decimal(10,2)")
    until = F.coalesce(get("$.offers.priceValidUntil"), get("$.offers[0].priceValidUntil"))
    return rows.select("url", get("$.name").alias("name"), image.alias("image"), F.coalesce(price, parse_price(F.regexp_replace("_html", r"(?s)<[^>]*>", " "))).alias("price"), parse_date(until).alias("valid_until")).where("name IS NOT NULL")


def links(pages: DataFrame, prefix: str, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct addresses that begin with ``prefix``, without fragment: (``url`` of the page, ``place``, ``link``)."""
    found = F.array_distinct(F.regexp_extract_all(F.col(html), F.lit(rf"href=[\"']({re.escape(prefix)}[^\"'#]*)"), F.lit(1)))
    return pages.select(F.col(url).alias("url"), F.posexplode(found).alias("place", "link"))


def last_page(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Number of the last page that a listing page links to (1 without links)."""
    numbers = F.transform(F.regexp_extract_all(F.col(html), F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    return pages.select(F.col(url).alias("url"), F.greatest(F.coalesce(F.array_max(numbers), F.lit(1)), F.lit(1)).alias("pages"))


def active_brochures(brochures: DataFrame, as_of: str, group: str = "store") -> DataFrame:
    """Brochures valid on the day ``as_of`` (open ends where a day is missing); of a store without one, its first.

    Days missing in the columns are read from the title, a range or a single last day. Sorted by store, last day (none
    is last) and title.
    """
    told = brochures.withColumns({"_days": date_range(F.col("title"), F.year(F.to_date(F.lit(as_of)))), "_day": parse_date(F.col("title"))})
    rows = told.withColumns({"day_from": F.coalesce("valid_from", "_days.day_from"), "day_until": F.coalesce("valid_until", "_days.day_until", "_day")}).drop("_days", "_day")
    today = F.to_date(F.lit(as_of))
    active = (F.col("day_from").isNull() | (F.col("day_from") <= today)) & (F.col("day_until").isNull() | (F.col("day_until") >= today))
    rows = rows.withColumn("active", active)
    any_active = rows.where("active").select(group).distinct()
    from marketgrain.operators.dedupe import keep_best

    rest = keep_best(rows.join(any_active, group, "left_anti"), [group], [F.asc("url")])
    return rows.where("active").unionByName(rest.select(rows.columns)).orderBy(group, F.col("day_until").asc_nulls_last(), "title", "url")


def script_table(spark: SparkSession, path: str, schema: str, rows: str | None = None) -> DataFrame:
    """Table in a script file ``const NAME = {…};`` or ``[…]``: the array, or the array under the field ``rows``."""
    text = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^\s*(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*", ""), r";\s*$", "")
    kind = f"array<struct<{schema}>>" if rows is None else f"struct<{rows}: array<struct<{schema}>>>"
    parsed = text.select(F.from_json(body, kind).alias("j")).select((F.col("j") if rows is None else F.col(f"j.{rows}")).alias("a"))
    return parsed.select(F.posexplode("a").alias("ord", "r")).select("ord", "r.*")


def json_document(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """Rows of a JSON document with an envelope: the array under the field ``rows``, with ``ord``."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{rows}: array<struct<{schema}>>>").alias("j"))
    return doc.select(F.posexplode(f"j.{rows}").alias("ord", "r")).select("ord", "r.*")


def file_keys(spark: SparkSession, path: str) -> DataFrame:
    """Distinct keys ('key':) that stand in text files: ``key``."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"'([^']+)'\s*:"), F.lit(1))).alias("key")).distinct()


def from_passes(passes: Sequence[Callable[[DataFrame], DataFrame]], pages: DataFrame, key: str) -> DataFrame:
    """Rows of several extraction passes over the same pages; of one key the earliest pass counts."""
    from marketgrain.operators.dedupe import union_first

    return union_first([f(pages) for f in passes], [key], [key])


def text_blocks(pages: DataFrame, words: str = "words") -> DataFrame:
    """Positioned text blocks (page, text, x0, y0, x1, y1) with their middles ``cx``, ``cy`` and ``ord``."""
    rows = pages.select("page", F.posexplode(words).alias("ord", "w")).select("page", "ord", "w.*")
    return rows.withColumns({"cx": (F.col("x0") + F.col("x1")) / 2, "cy": (F.col("y0") + F.col("y1")) / 2})


def key_values(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Per-day key-value states: lines ``{"key": "<prefix>YYYY-MM-DD", "value": {habit: bool}}`` as (day, habit, done)."""
    rows = spark.read.json(path, schema="key string, value map<string, boolean>").where(F.startswith("key", F.lit(prefix)))
    return rows.select(F.try_to_date(F.substring("key", len(prefix) + 1, 10)).alias("day"), F.explode("value").alias("habit", "done"))


