"""SQL of the queries of this subpackage, where SQL can ask the same question."""

from __future__ import annotations

from marketgrain.llm.survivors import PER_STORE
from marketgrain.plans.impute_sql import JUDGED
from marketgrain.plans.measure_sql import plain

P2_FOUND = f"""WITH {JUDGED},
uses AS (SELECT DISTINCT trim(image) AS v, {plain("store")} AS s, id, emoji FROM offers WHERE image IS NOT NULL AND trim(image) <> ''),
many AS (SELECT v FROM uses GROUP BY v HAVING min(emoji) < max(emoji) OR count(DISTINCT (s, id)) > {PER_STORE} * count(DISTINCT coalesce(s, ''))),
r AS (SELECT ord, id, valid_from, valid_until, coalesce(is_true, false) AS t,
  image IS NOT NULL AND trim(image) <> '' AND NOT regexp_matches(image, '(?i)placeholder|no[-_]?image|/default/|^data:|blank\\.|dummy|missing') AND trim(image) NOT IN (SELECT v FROM many) AS p FROM judged)
SELECT min(ord) AS ord FROM r GROUP BY id, valid_from, valid_until HAVING count(*) >= 2 AND bool_or(p) AND bool_or(t) AND NOT bool_or(p AND t)"""
