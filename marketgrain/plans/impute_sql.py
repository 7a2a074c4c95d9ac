"""What is missing (``operators.impute``) as SQL: head words, kinds of item with true zeros, stand-ins."""

from __future__ import annotations

from marketgrain.operators.impute import MACROS, NOTHING
from marketgrain.plans.measure_sql import folded, plain

GIVEN = " AND ".join(f"coalesce(macros.{m} >= 0 AND NOT isnan(macros.{m}), false)" for m in MACROS)
ZERO = " AND ".join(f"coalesce(macros.{m}, -1) = 0" for m in MACROS)
BLANK = f"""(category IS NULL OR {plain("category")} IN ({", ".join("'" + n + "'" for n in NOTHING)}) OR NOT regexp_matches({plain("category")}, '\\p{{L}}'))"""
_WORDS = rf"string_split_regex({folded('name')}, '[^\p{{L}}]+')"

#: Common table expressions up to ``judged``: offers with ``is_true`` (macros are true ones) and ``no_category``.
JUDGED = f"""texts AS (SELECT DISTINCT name, emoji FROM offers WHERE name IS NOT NULL AND emoji IS NOT NULL),
tok AS (SELECT DISTINCT name, emoji, unnest({_WORDS}) AS t FROM texts),
cnt AS (SELECT t, emoji, count(*) AS k FROM tok WHERE length(t) >= 3 GROUP BY t, emoji),
voc AS (SELECT t, row_number() OVER (ORDER BY n DESC, t) AS r FROM (SELECT t, sum(k) AS n, max(k) AS m FROM cnt GROUP BY t) WHERE n >= 3 AND n >= 2e-5 * (SELECT sum(k) FROM cnt) AND m >= 0.8 * n),
nam AS (SELECT DISTINCT name, unnest({_WORDS}) AS t FROM offers WHERE name IS NOT NULL),
heads AS (SELECT name, min(r) AS head FROM nam JOIN voc ON nam.t = voc.t GROUP BY name),
o AS (SELECT offers.*, head FROM offers LEFT JOIN heads ON offers.name = heads.name),
zero_kinds AS (SELECT head FROM o WHERE {GIVEN} AND head IS NOT NULL GROUP BY head HAVING count(*) >= 5 AND count(*) FILTER ({ZERO}) >= 0.5 * count(*)),
spread AS (SELECT category AS v FROM (SELECT category, emoji, count(*) AS n FROM offers WHERE category IS NOT NULL AND emoji IS NOT NULL GROUP BY ALL) GROUP BY category HAVING sum(n) >= 10 AND max(n) < 0.6 * sum(n)),
judged AS (SELECT *, {GIVEN} AND (NOT ({ZERO}) OR head IN (SELECT head FROM zero_kinds)) AS is_true, {BLANK} OR category IN (SELECT v FROM spread) AS no_category FROM o)"""

MISSING = f"""WITH {JUDGED}
SELECT ord, 'category' AS field FROM judged WHERE no_category
UNION ALL SELECT ord, 'macros' FROM judged WHERE is_food AND NOT coalesce(is_true, false)
UNION ALL SELECT ord, 'old_price' FROM judged WHERE discount_pct > 0 AND NOT coalesce(old_price > 0 AND abs(old_price * (1 - discount_pct / 100) - new_price) <= 0.0101, false)"""
