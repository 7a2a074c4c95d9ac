"""The reading of contents (``functions.measure``) as SQL for engines whose regular expressions have no look-around.

Look-behind and look-ahead become groups that take the neighbouring character; only the first match counts, so that
nothing is lost by it.
"""

from __future__ import annotations

from marketgrain.functions import measure
from marketgrain.functions.text import BLANKS, INVISIBLE, LATIN, LOOKALIKES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _pattern(pattern: str) -> str:
    plain = pattern.replace(measure._BEFORE, r"(?:^|[^\p{L}\d.,%])").replace(measure._END, r"(?:$|[^\p{L}\d])")
    return _quoted(plain)


def _class(pattern: str) -> str:
    """A character class with its characters as escapes."""
    return _quoted("".join(c if ord(c) < 128 else rf"\x{{{ord(c):X}}}" for c in pattern))


def plain(text: str) -> str:
    """``functions.text.plain`` of a SQL expression."""
    wide = "".join(chr(o) for o in range(0xFF01, 0xFF5F))
    ascii_ = "".join(chr(o) for o in range(0x21, 0x7F))
    t = f"regexp_replace(translate({text}, {_quoted(wide)}, {_quoted(ascii_)}), {_class(INVISIBLE)}, '', 'g')"
    return f"lower(trim(regexp_replace({t}, {_class(BLANKS)}, ' ', 'g')))"


def folded(text: str) -> str:
    """``plain`` with look-alike letters made one."""
    return f"translate({plain(text)}, '{LOOKALIKES}', '{LATIN}')"


def form(text: str) -> str:
    """``functions.measure.measure_form`` of a SQL expression."""
    t = rf"regexp_replace({folded(text)}, 'пoлo?bиh(?:ka)?( ?\p{{L}})', '0.5\1', 'g')"
    t = rf"regexp_replace({t}, '(^|[^\d/])1/2($|[^\d/])', '\1 0.5\2', 'g')"
    t = rf"replace({t}, '½', '0.5')"
    return rf"replace(regexp_replace({t}, '(^|[^\d/])1/4($|[^\d/])', '\1 0.25\2', 'g'), '¼', '0.25')"


def total(form_column: str) -> str:
    """Grams or millilitres of the whole package that the form states, or null."""
    get = lambda p, i: f"regexp_extract({form_column}, {_pattern(p)}, {i})"

    def grams(n: str, u: str) -> str:
        small = "|".join(measure.UNITS[k][0] for k in ("g", "ml", "mg"))
        number = f"replace({n}, ' ', '')"
        digits = rf"CASE WHEN regexp_full_match({u}, {_quoted(small)}) AND regexp_full_match({number}, '[1-9]\d?[.,]\d{{3}}') THEN regexp_replace({number}, '[.,]', '') ELSE replace({number}, ',', '.') END"
        factor = " ".join(f"WHEN regexp_full_match({u}, {_quoted(p)}) THEN {f!r}" for p, f in measure.UNITS.values())
        return f"TRY_CAST({digits} AS DOUBLE) * CASE {factor} END"

    has = lambda p: f"regexp_matches({form_column}, {_pattern(p)})"
    two = f"{grams(get(measure.TWO, 1), get(measure.TWO, 2))} + TRY_CAST({get(measure.TWO, 3)} AS INTEGER)"
    first = f"{grams(get(measure.MANY_FIRST, 2), get(measure.MANY_FIRST, 3))} * TRY_CAST({get(measure.MANY_FIRST, 1)} AS INTEGER)"
    last = f"{grams(get(measure.MANY_LAST, 1), get(measure.MANY_LAST, 2))} * TRY_CAST({get(measure.MANY_LAST, 3)} AS INTEGER)"
    one = grams(get(measure.ONE, 1), get(measure.ONE, 2))
    return f"nullif(greatest(CASE WHEN {has(measure.TWO)} THEN {two} WHEN {has(measure.MANY_FIRST)} THEN {first} WHEN {has(measure.MANY_LAST)} THEN {last} WHEN {has(measure.ONE)} THEN {one} END, 0), 0)"


def differing(tolerance: float) -> str:
    """Rows (ord, field) of offers whose stored content or unit price differs from what the text states."""
    return f"""WITH t AS (SELECT ord, weight_grams AS w, price_per_kg AS p, new_price AS n, {form("coalesce(weight_raw, name)")} AS t FROM offers),
c AS (SELECT ord, w, p, n, {total("t")} AS c FROM t)
SELECT ord, 'weight_grams' AS field FROM c WHERE abs(w - c) > {tolerance} * c
UNION ALL SELECT ord, 'price_per_kg' FROM c WHERE abs(p - n / c * 1000) > {tolerance} * (n / c * 1000)"""
