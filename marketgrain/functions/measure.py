"""Contents of a package stated in words: '4 х 85 г', '6 бр. по 8 oz', '0,500 кг × 4', 'половин килограм', '33 сл'.

Everything is a Column expression: regular expressions run in the JVM on a comparison form of the text in which
look-alike letters of two alphabets are one letter, so 'КГ' typed with a Latin K is still kilograms.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketgrain.functions.text import fold_lookalikes, plain

# Units as they stand in the comparison form (Cyrillic а в е к м н о р с т у х are Latin there),
# with grams or millilitres of one unit.
UNITS = {
    "kg": (r"kг|kg|kgs|kилoг?pam[\p{L}]*|kilo[\p{L}]*", 1000.0),
    "mg": (r"mг|mg", 0.001),
    "g": (r"г|гp|гp?a?m?a?|гpamob?e?|g|gr|gm|gram[\p{L}]*", 1.0),
    "cl": (r"cл|cl", 10.0),
    "dl": (r"dl|дл", 100.0),
    "ml": (r"mл|ml|mили[\p{L}]+|milli[\p{L}]*", 1.0),
    "l": (r"л|l|ltr|лиt[\p{L}]*|лtpa|лиpa|иtpa|lit[er][\p{L}]*", 1000.0),
    "oz": (r"oz|ounces?|унци[\p{L}]*", 28.349523125),
    "lb": (r"lbs?|фунt[\p{L}]*|pounds?", 453.59237),
}
_NUMBER = r"\d{1,2} \d00|\d+(?:[.,]\d+)?"
_UNIT = "|".join(p for p, _ in UNITS.values())
_END = r"(?![\p{L}\d])"
_BEFORE = r"(?<![\p{L}\d.,%])"
_TIMES = r"\s*(?:x|×|\*)\s*"
_EACH = r"\s*(?:x|×|\*|бp(?:oя|oй|\.)?\s*пo|pcs?\.?\s*(?:x|of|by))\s*"
#: whole and part: '1 кг и 500 г'
TWO = rf"{_BEFORE}(\d{{1,3}})\s*({UNITS['kg'][0]}|{UNITS['l'][0]})\.?\s*(?:и|and|\+|,)?\s*(\d{{1,3}})\s*(?:{UNITS['g'][0]}|{UNITS['ml'][0]})\.?{_END}"
#: pieces, number, unit
MANY_FIRST = rf"{_BEFORE}(\d{{1,3}}){_EACH}({_NUMBER})\s*({_UNIT})\.?{_END}"
#: number, unit, pieces
MANY_LAST = rf"{_BEFORE}({_NUMBER})\s*({_UNIT})\.?{_TIMES}(\d{{1,3}}){_END}"
ONE = rf"{_BEFORE}({_NUMBER})\s*({_UNIT})\.?{_END}"
COUNT = rf"{_BEFORE}(\d{{1,4}})\s*(?:бp(?:oя|oй)?|pcs?|pieces?)\.?+{_END}(?!\s*пo\s+\d)"


def measure_form(text: Column) -> Column:
    """Comparison form in which contents are read: plain, look-alikes folded, halves as decimals."""
    t = fold_lookalikes(plain(text))
    t = F.regexp_replace(t, r"пoлo?bиh(?:ka)?(?= ?[\p{L}])", "0.5")
    t = F.regexp_replace(t, r"(?<![\d/])1/2(?![\d/])|½", "0.5")
    return F.regexp_replace(t, r"(?<![\d/])1/4(?![\d/])|¼", "0.25")


def _bind(value: Column, f):
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _grams(s: Column) -> Column:
    """Grams or millilitres of the struct's number ``n`` and unit ``u``."""
    small = s["u"].rlike(rf"^(?:{UNITS['g'][0]}|{UNITS['ml'][0]}|{UNITS['mg'][0]})$")
    n = F.regexp_replace(s["n"], " ", "")
    thousands = small & n.rlike(r"^[1-9]\d?[.,]\d{3}$")
    n = F.when(thousands, F.regexp_replace(n, "[.,]", "")).otherwise(F.regexp_replace(n, ",", "."))
    factor = F.lit(None).cast("double")
    for pattern, grams in reversed(list(UNITS.values())):
        factor = F.when(s["u"].rlike(rf"^(?:{pattern})$"), F.lit(grams)).otherwise(factor)
    return n.try_cast("double") * factor + F.coalesce(s["more"], F.lit(0))


def stated(text: Column) -> Column:
    """Struct (each, pieces, total, count): grams or millilitres of one piece, number of pieces, their product, and a
    plain number of items ('10 бр.'). Fields are null where the text states no such thing; a null text gives nulls.
    """

    def parts(t: Column) -> Column:
        got = lambda p, n, u, k: F.struct(F.regexp_extract(t, p, n).alias("n"), F.regexp_extract(t, p, u).alias("u"), (F.regexp_extract(t, p, k).try_cast("int") if k else F.lit(1)).alias("k"), F.lit(None).cast("int").alias("more"))
        two = F.struct(F.regexp_extract(t, TWO, 1).alias("n"), F.regexp_extract(t, TWO, 2).alias("u"), F.lit(1).alias("k"), F.regexp_extract(t, TWO, 3).try_cast("int").alias("more"))
        # the forms with several numbers are looked for only where their sign or word stands
        best = (
            F.when(~t.rlike(r"\d"), F.lit(None))
            .when(t.rlike(r"\d\D{1,20}\d") & t.rlike(TWO), two)
            .when(t.rlike(r"[x×*]|пo|of|by") & t.rlike(MANY_FIRST), got(MANY_FIRST, 2, 3, 1))
            .when(t.rlike(r"[x×*]\s*\d") & t.rlike(MANY_LAST), got(MANY_LAST, 1, 2, 3))
            .when(t.rlike(ONE), got(ONE, 1, 2, 0))
        )
        return F.struct(best.alias("b"), F.when(t.rlike(r"\d\s*[бp]"), F.regexp_extract(t, COUNT, 1).try_cast("int")).alias("count"))

    def result(s: Column) -> Column:
        return _bind(F.struct(_grams(s["b"]).alias("each"), s["b"]["k"].alias("k"), s["count"].alias("count")), whole)

    def whole(s: Column) -> Column:
        ok = (s["each"] > 0) & (s["k"] > 0)
        return F.struct(F.when(ok, s["each"]).alias("each"), F.when(ok, s["k"]).alias("pieces"), F.when(ok, s["each"] * s["k"]).alias("total"), s["count"].alias("count"))

    return _bind(_bind(measure_form(text), parts), result)
