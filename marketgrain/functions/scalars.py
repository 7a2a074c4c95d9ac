"""Scalar functions on texts, prices and dates. Built-ins wherever Spark has them."""

from __future__ import annotations

import difflib
import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketgrain.functions.text import plain


def parse_price(text: Column) -> Column:
    """Price in a text as DECIMAL(10,2): a number before лв/lv/bgn, else one with two decimals, else a bare number."""
    t = F.regexp_replace(F.lower(text), "[\\u00a0\\s]+", " ")
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    found = F.coalesce(number(r"(\d+(?:[.,]\d+)?) ?(?:лв|lv|bgn)"), number(r"(\d+[.,]\d{2})(?!\d)"), number(r"^ ?(\d+(?:[.,]\d+)?) ?$"))
    return F.regexp_replace(found, ",", ".").try_cast("decimal(10,2)")


def parse_date(text: Column, year: Column | None = None) -> Column:
    """DATE in a text: ISO, dd.mm.yyyy, dd.mm.yy (of this century) or, with ``year``, dd.mm; impossible days are null."""
    iso = F.try_to_date(F.nullif(F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")))
    pattern = r"(?<![\d.])(\d{1,2})\.(\d{1,2})(?:\.(\d{4}|\d{2}))?(?!\d|\.\d)"
    part = lambda i: F.regexp_extract(text, pattern, i)
    bare = F.lit(None).cast("string") if year is None else year.cast("string")
    y = F.when(F.length(part(3)) == 4, part(3)).when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(bare)
    # a null year makes a null day, where concat_ws would leave it out
    return F.coalesce(iso, F.try_to_date(F.concat(y, F.lit("-"), F.lpad(part(2), 2, "0"), F.lit("-"), F.lpad(part(1), 2, "0"))))


def date_range(text: Column, year: Column | None = None) -> Column:
    """Struct (day_from, day_until) of a range such as '03.04. - 09.04.2026'; the first day may lack its year."""
    last = F.regexp_extract(text, r"[-–]\s*(.+)$", 1)
    until = parse_date(last, year)
    first = F.rtrim(F.regexp_replace(F.regexp_extract(text, r"^(.*?)\s*[-–]", 1), r"\.\s*$", ""))
    return F.struct(parse_date(first, F.coalesce(F.year(until), year if year is not None else F.lit(None))).alias("day_from"), until.alias("day_until"))


def moment_to_date(text: Column) -> Column:
    """DATE of an ISO moment with or without zone; else of its first ten characters; else null."""
    return F.coalesce(F.to_date(F.try_to_timestamp(text)), F.try_to_date(F.substring(text, 1, 10)))


def last_of_srcset(text: Column) -> Column:
    """Address of the last candidate of a srcset attribute."""
    return F.nullif(F.split(F.trim(F.element_at(F.split(text, ","), -1)), r"\s+")[0], F.lit(""))


def match_name(text: Column) -> Column:
    """Name for matching: lower case, letters and digits with single blanks, no units of contents."""
    t = F.regexp_replace(plain(text), r"(?U)\d+(?:[.,]\d+)?\s*(?:кг|г|гр|мл|л|бр|kg|g|ml|l|pcs)\b\.?", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "), " +", " "))


def tokens(text: Column, least: int = 3) -> Column:
    """Distinct words of at least ``least`` characters, in order of appearance."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+")), lambda t: F.length(t) >= least)


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two token arrays: intersection over union, 0 for two empty ones."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity; null where a side is null. No built-in has this measure."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def unaccented(text: pd.Series) -> pd.Series:
    """Text without combining marks (canonical decomposition)."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Entities of HTML in characters."""
    return text.map(lambda t: None if t is None else html.unescape(t))


def html_escape(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def script_string(text: Column) -> Column:
    """Text as the inside of a single-quoted script string."""
    for raw, escaped in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def slug(text: Column, most: int = 80) -> Column:
    """Lower-case words joined by hyphens, without marks, cut to ``most`` characters."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(unaccented(text)), r"[^\p{L}\p{N}]+", "-"), "^-|-$", ""), F.lit(most))


def short_id(*parts: Column, size: int = 6) -> Column:
    """First characters of the MD5 of the joined parts."""
    return F.left(F.md5(F.concat_ws("-", *parts)), F.lit(size))


def additive_codes(text: Column) -> Column:
    """Codes of additives (E 150d, Е-202) in order of appearance, distinct, as 'E150D'."""
    found = F.regexp_extract_all(text, F.lit(r"(?iU)\b[eе][\s\-]?(\d{3,4}[a-z]?)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda c: F.concat(F.lit("E"), F.upper(c))))


def repair_mixed_script(text: Column) -> Column:
    """Words with a Cyrillic letter have their Latin look-alikes made Cyrillic; other words stay."""
    # Latin letters and the Cyrillic ones that look like them, in one order.
    fixed = lambda w: F.when(w.rlike("[\\u0400-\\u04ff]"), F.translate(w, "ABCEHKMOPTXYabceopxy", "АВСЕНКМОРТХУавсеорху")).otherwise(w)
    return F.array_join(F.transform(F.split(text, " "), fixed), " ")


def euro(leva: Column, rate: float = 1.95583) -> Column:
    """Leva in euro, in hundredths, halves upwards."""
    return F.floor(leva / F.lit(rate) * 100 + 0.5) / 100


def week_start(moment: Column) -> Column:
    """Monday of the moment's week, as DATE."""
    return F.to_date(F.date_trunc("week", moment))
