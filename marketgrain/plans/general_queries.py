"""Queries of derived values, overlays, selections and reports, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.functions import metrics, scalars
from marketgrain.operators import joins, rank, texts
from marketgrain.plans.core_queries import _UNIT, _VALID, _VALUE
from marketgrain.plans.offers_query import has_word, in_stores, offers_query, protein_for_money, valid
from marketgrain.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _offers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers")


@query("""WITH o AS (SELECT ord, new_price AS n, CASE WHEN old_price > 0 AND NOT isnan(old_price) THEN old_price END AS p, discount_pct AS d FROM offers)
SELECT ord, coalesce(p, CASE WHEN d > 0 AND d < 100 THEN floor(n / (1 - d / 100) * 100 + 0.5) / 100 END) AS old_price, CASE WHEN p > n THEN CAST(floor((1 - n / p) * 100 + 0.5) AS INTEGER) ELSE d END AS discount,
CASE WHEN coalesce(p > 0 OR d > 0, false) THEN 'promo' ELSE 'assortment' END AS kind FROM o""")
def prices_from_discounts(spark: SparkSession, d: str) -> DataFrame:
    """Old price and discount derived from each other, and the kind of offer they tell."""
    old, new, pct = F.col("old_price"), F.col("new_price"), F.col("discount_pct")
    kind = metrics.promotion_or_not(metrics.positive(old), pct)
    return _offers(spark, d).select("ord", metrics.derived_old_price(old, new, pct).alias("old_price"), metrics.derived_discount(old, new, pct).alias("discount"), kind.alias("kind"))


@query(f"SELECT ord, round({_UNIT}, 6) AS unit_price, round({_VALUE}, 6) AS protein_for_money FROM offers")
def unit_prices_and_protein(spark: SparkSession, d: str) -> DataFrame:
    """Reliable unit price of every offer, and its adjusted protein for a euro."""
    unit = metrics.reliable_unit_price(F.col("price_per_kg"), F.col("new_price"), F.col("weight_grams"))
    return _offers(spark, d).select("ord", F.round(unit, 6).alias("unit_price"), F.round(protein_for_money(), 6).alias("protein_for_money"))


@query("""WITH b AS (SELECT category, max(macros.sugar) AS sugar, max(macros.fiber) AS fiber, max(macros.kcal) AS kcal FROM offers WHERE category IS NOT NULL AND NOT isnan(coalesce(macros.sugar, 0)) AND NOT isnan(coalesce(macros.fiber, 0)) AND NOT isnan(coalesce(macros.kcal, 0)) GROUP BY category)
SELECT ord, CASE WHEN macros IS NULL THEN b.kcal ELSE macros.kcal END AS kcal, CASE WHEN macros IS NULL THEN b.sugar ELSE coalesce(macros.sugar, b.sugar) END AS sugar, CASE WHEN macros IS NULL THEN b.fiber ELSE coalesce(b.fiber, macros.fiber) END AS fiber FROM offers LEFT JOIN b ON offers.category = b.category""")
def macros_overlaid(spark: SparkSession, d: str) -> DataFrame:
    """Macros laid over with those of the category: all where there are none, sugar where missing, fiber preferred."""
    o = _offers(spark, d)
    whole = F.lit(True)
    for k in ("sugar", "fiber", "kcal"):
        whole = whole & ~F.isnan(F.coalesce(f"macros.{k}", F.lit(0.0)))
    by = o.where(F.col("category").isNotNull() & whole).groupBy("category").agg(F.struct(*[F.max(f"macros.{k}").alias(k) for k in ("kcal", "sugar", "fiber")]).alias("other"))
    laid = metrics.overlaid("macros", "other", ["kcal", "sugar", "fiber"], prefer=["fiber"], fill=["sugar"])
    return o.join(by, "category", "left").select("ord", laid.alias("m")).select("ord", "m.kcal", "m.sugar", "m.fiber")


@query("""SELECT ord, CASE WHEN contains(lower(name), 'крем') THEN NULL WHEN contains(lower(name), 'вода') THEN 0.0 ELSE macros.kcal END AS kcal, CASE WHEN contains(lower(name), 'крем') THEN NULL WHEN contains(lower(name), 'зехтин') AND NOT contains(lower(name), 'вода') THEN 100.0 ELSE macros.f END AS f FROM offers WHERE macros IS NOT NULL""")
def macros_by_rules(spark: SparkSession, d: str) -> DataFrame:
    """Macros under rules: none for some words, else values of the first rule laid over them."""
    has = lambda w: F.contains(F.lower("name"), F.lit(w))
    m = metrics.ruled("macros", ["kcal", "p", "f", "c"], has("крем"), [(has("вода"), {"kcal": 0.0}), (has("зехтин"), {"f": 100.0})])
    o = _offers(spark, d).where("macros IS NOT NULL").withColumn("macros", F.struct(*[f"macros.{k}" for k in ("kcal", "p", "f", "c")]))
    return o.select("ord", m.alias("m")).select("ord", "m.kcal", "m.f")


@query("""SELECT ord, CASE WHEN contains(lower(name), 'крем') THEN NULL WHEN contains(lower(name), 'сирене') THEN (CASE WHEN category = 'dairy' THEN 'сирене' END) WHEN contains(lower(name), 'мляко') THEN 'мляко' END AS key FROM offers""")
def keys_with_veto(spark: SparkSession, d: str) -> DataFrame:
    """The first keyword of a name, stopped by disqualifying words and by a keyword whose category differs."""
    return _offers(spark, d).select("ord", metrics.first_unless(F.col("name"), ["крем"], [("сирене", F.col("category") == "dairy"), ("мляко", None)]).alias("key"))


@query("""SELECT ord, coalesce(CASE WHEN trim(category) <> '' THEN category END, CASE WHEN trim(source_type) <> '' THEN source_type END, CASE WHEN trim(source) <> '' THEN source END) AS text, coalesce(shelf_life, weight_raw) AS shelf_life FROM offers""")
def language_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Texts in a wanted language with fallbacks, and a field filled only where it is missing."""
    values = {"bg": F.col("source_type"), "en": F.col("category"), "raw": F.col("source")}
    kept = metrics.filled({"shelf_life": F.col("shelf_life")}, {"shelf_life": F.col("weight_raw")})
    return _offers(spark, d).select("ord", metrics.in_language(values, "en", ["bg", "en", "raw"]).alias("text"), kept["shelf_life"].alias("shelf_life"))


@query(r"""SELECT ord, coalesce(len(string_split_regex(trim(name), '\s+')) > 6 OR regexp_matches(name, '[^\p{L}\p{N}\s]{4,}') OR length(regexp_replace(name, '[^\p{L}]', '', 'g')) < 0.7 * length(name), true) AS garbage,
trim(regexp_replace(regexp_replace(name, '^\s*\d+[.)]\s*', ''), '\s+', ' ', 'g'), ' *.,/-') AS clean, regexp_matches(name, '[Ѐ-ӿ]') AND length(trim(name)) > 5 AND category IS NULL AS translatable FROM offers""")
def names_cleaned_and_judged(spark: SparkSession, d: str) -> DataFrame:
    """Names cleaned, judged as garbage of text recognition, and as worth translating."""
    name = F.col("name")
    return _offers(spark, d).select("ord", metrics.unreadable(name, 6, 0.7).alias("garbage"), metrics.clean_name(name).alias("clean"), metrics.translatable(name, F.col("category").isNotNull()).alias("translatable"))


@query("""SELECT event_id FROM events WHERE coalesce(user_id BETWEEN 8 AND 99, false) AND coalesce(value BETWEEN 10 AND 60, false)""")
def rows_within_bounds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(metrics.within({"user_id": (8, 99), "value": (10, 60)})).select("event_id")


@query("""SELECT c.c_custkey, array_to_string(list_sort(list_distinct(list_concat([c.c_mktsegment, n.n_name], [n.n_name, 'any']))), ',') AS tags, CASE WHEN c.c_acctbal < 0 THEN 'new' ELSE c.c_mktsegment END AS kind, n.n_name AS place FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def tags_and_attributes_merged(spark: SparkSession, d: str) -> DataFrame:
    """Union of tags, and a map of attributes over which another one is laid."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    tags = F.array_union(F.array("c_mktsegment", "n_name"), F.array(F.col("n_name"), F.lit("any")))
    base = F.create_map(F.lit("kind"), F.col("c_mktsegment"), F.lit("place"), F.col("n_name"))
    laid = metrics.merged(base, F.when(F.col("c_acctbal") < 0, F.create_map(F.lit("kind"), F.lit("new"))))
    return rows.select("c_custkey", F.array_join(F.array_sort(tags), ",").alias("tags"), laid["kind"].alias("kind"), laid["place"].alias("place"))


@query(f"""WITH r AS (SELECT ord, product_id, {_VALUE} AS v, row_number() OVER (PARTITION BY product_id ORDER BY {_VALUE} DESC, health_score DESC NULLS LAST, ord) AS n FROM offers WHERE product_id IS NOT NULL AND {_VALID} AND category IN ('protein', 'dairy') AND health_score >= 6)
SELECT ord, row_number() OVER (ORDER BY v DESC, h DESC NULLS LAST, ord) AS place FROM (SELECT r.ord, v, o.health_score AS h FROM r JOIN offers o ON o.ord = r.ord WHERE n = 1) QUALIFY place <= 4""")
def four_products_by_protein(spark: SparkSession, d: str) -> DataFrame:
    """The four best products of some categories, each once, by protein for money and score."""
    rows = _offers(spark, d).where(valid() & F.col("category").isin("protein", "dairy") & (F.col("health_score") >= 6)).withColumn("v", protein_for_money())
    return rank.unique_top(rows, "product_id", [F.desc("v"), F.desc_nulls_last("health_score"), F.col("ord")], 4).select("ord", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH k AS (SELECT ord, discount_pct, CASE WHEN price_per_kg > 0 THEN price_per_kg ELSE 999 END AS u, health_score AS h FROM offers WHERE {_VALID} AND is_bulk_worthy)
SELECT ord, row_number() OVER (ORDER BY h DESC NULLS LAST, u, coalesce(discount_pct, 0) DESC, ord) AS place FROM k QUALIFY place <= 12""")
def bulk_shelf(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best rows worth buying in bulk: by score, unit price (missing ones last) and discount."""
    unit = F.when(F.col("price_per_kg") > 0, F.col("price_per_kg")).otherwise(999)
    rows = _offers(spark, d).where(valid() & F.col("is_bulk_worthy"))
    return rank.top(rows, [F.desc_nulls_last("health_score"), unit, F.coalesce("discount_pct", F.lit(0)).desc(), F.col("ord")], 12).select("ord", F.col("place").cast("bigint").alias("place"))


@query(f"""WITH h AS (SELECT product_id, count(*) AS n FROM all_products WHERE new_price IS NOT NULL GROUP BY 1)
SELECT o.ord FROM offers o LEFT JOIN h ON h.product_id = o.product_id WHERE {_VALID} ORDER BY coalesce(h.n, 0) DESC, coalesce(discount_pct, 0) DESC, o.ord LIMIT 36""")
def listing_by_history(spark: SparkSession, d: str) -> DataFrame:
    """The listing by the length of the price history, which comes from the snapshots."""
    log = table(spark, d, "all_products").where("new_price IS NOT NULL").groupBy("product_id").agg(F.collect_list("new_price").alias("price_history"))
    return offers_query(_offers(spark, d).join(log, "product_id", "left"), sort="history", page=1).select("ord")


@query("""WITH s AS (SELECT category, list_distinct(list(lower(trim(store)))) AS stores FROM offers WHERE category IS NOT NULL GROUP BY 1) SELECT o.ord FROM offers o LEFT JOIN s ON s.category = o.category WHERE list_contains(coalesce(stores, [lower(trim(o.store))]), 'maslinka 24') OR list_contains(coalesce(stores, [lower(trim(o.store))]), 'zelenika')""")
def offers_of_available_stores(spark: SparkSession, d: str) -> DataFrame:
    """Rows of which one of two stores is among the available ones, by default the row's own."""
    o = _offers(spark, d)
    by = o.where("category IS NOT NULL").groupBy("category").agg(F.collect_set(F.lower(F.trim("store"))).alias("available_stores"))
    return o.join(by, "category", "left").where(in_stores("Maslinka 24") | in_stores(" Zelenika")).select("ord")


@query("""WITH t AS (SELECT snap_id, product_id, name, store, row_number() OVER (PARTITION BY product_id ORDER BY snap_id DESC) AS a, row_number() OVER (PARTITION BY name, store ORDER BY snap_id DESC) AS b FROM all_products)
SELECT o.ord, coalesce(x.snap_id, y.snap_id) AS snap_id FROM offers o LEFT JOIN (SELECT * FROM t WHERE a = 1) x ON x.product_id = o.product_id LEFT JOIN (SELECT * FROM t WHERE b = 1) y ON y.name = o.name AND y.store = o.store""")
def stored_by_two_keys(spark: SparkSession, d: str) -> DataFrame:
    """The last stored row of each offer: by product, else by name and store."""
    stored = table(spark, d, "all_products")
    return joins.by_two_keys(_offers(spark, d).select("ord", "product_id", "name", "store"), stored.select("snap_id", "product_id", "name", "store"), ["product_id"], ["name", "store"], "snap_id", ["snap_id"]).select("ord", "snap_id")


@query("""WITH p AS (SELECT o_custkey AS src, o_orderkey % 50 AS page, count(*) FILTER (o_totalprice > 100000) AS n FROM orders GROUP BY ALL), e AS (SELECT src, min(page) AS stop FROM p WHERE n = 0 GROUP BY src)
SELECT p.src, p.page, p.n FROM p LEFT JOIN e ON e.src = p.src WHERE e.stop IS NULL OR p.page < e.stop""")
def pages_before_an_empty_one(spark: SparkSession, d: str) -> DataFrame:
    """Numbered pages of each source up to its first page without rows."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("page")).agg(F.count_if(F.col("o_totalprice") > 100000).alias("n"))
    return joins.until_empty(o, "src", "page", F.col("n") == 0).select("src", "page", "n")


@query(r"""WITH w AS (SELECT ord, 1 AS k, unnest(string_split_regex(lower(name), '[^\p{L}\p{N}]+')) AS w FROM offers UNION ALL SELECT ord, 2, unnest(string_split_regex(lower(store), '[^\p{L}\p{N}]+')) FROM offers UNION ALL SELECT ord, 3, unnest(string_split_regex(lower(category), '[^\p{L}\p{N}]+')) FROM offers),
s AS (SELECT ord, k, least(min(levenshtein(w, 'шоколад') / 7.0), 1.0) AS s FROM w WHERE w <> '' GROUP BY ALL)
SELECT ord, round(exp(sum(CASE k WHEN 1 THEN 0.55 WHEN 2 THEN 0.12 ELSE 0.1 END * ln(greatest(s, 0.001)))), 6) AS score FROM s WHERE s <= 0.28 GROUP BY ord""")
def weighted_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows that hold a word near the wanted one in one of several columns, scored by the columns' weights."""
    return texts.weighted_search(_offers(spark, d), "ord", {"name": 0.55, "store": 0.12, "category": 0.1}, "Шоколад ", 0.28).select("ord", F.round("score", 6).alias("score"))


@query(None)
def fuzzy_names_between_sources(spark: SparkSession, d: str) -> DataFrame:
    """Best stored product name of the names of every hundredth offer; difflib's ratio has no SQL, so brute force tests it."""
    asked = _offers(spark, d).where("ord % 100 = 0 AND name IS NOT NULL").select(F.col("name").alias("asked")).distinct()
    names = table(spark, d, "all_products").where("name IS NOT NULL").select(F.col("name").alias("found")).distinct()
    return joins.fuzzy_best(asked, names, "asked", "asked", "found", "found", 0.3)


@query(f"""WITH o AS (SELECT ord, lower(concat_ws(' ', name, store, category, array_to_string(diet_tags, ' '))) AS t FROM offers WHERE {_VALID})
SELECT ord FROM o WHERE contains(t, 'skyr') OR contains(t, 'скир')""")
def search_with_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """A search finds what any word of its synonym group is in."""
    return offers_query(_offers(spark, d), search="Skyr", synonyms=[["скир", "skyr"], ["леща", "lentils"]]).select("ord")


@query("""SELECT ord, array_to_string(list_transform(string_split(name, ' '), lambda w: CASE WHEN regexp_matches(w, '[Ѐ-ӿ]') THEN translate(w, 'ABCEHKMOPTXYabceopxy', 'АВСЕНКМОРТХУавсеорху') ELSE w END), ' ') AS repaired,
replace(replace(replace(replace(replace(name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html, list_contains(string_split_regex(lower(name), '\\s+'), 'мляко') AS milk FROM offers WHERE name IS NOT NULL""")
def names_repaired_and_escaped(spark: SparkSession, d: str) -> DataFrame:
    """Names with look-alike letters repaired, escaped for HTML, and whether a word stands in them."""
    name = F.col("name")
    rows = _offers(spark, d).where("name IS NOT NULL").withColumn("low", F.lower("name"))
    return rows.select("ord", scalars.repair_mixed_script(name).alias("repaired"), scalars.html_escape(name).alias("html"), has_word("low", "мляко").alias("milk"))


@query("""WITH f AS (SELECT ord, list_distinct(list_transform(regexp_extract_all(macros.ingredients, '(?i)(?:^|[^\\p{L}\\p{N}_])[EЕ][ -]?([0-9]{3,4}[a-z]?)', 1), lambda x: upper(x))) AS c FROM offers WHERE macros.ingredients IS NOT NULL)
SELECT ord, array_to_string(list_sort(list_transform(c, lambda x: 'E' || x)), ',') AS codes FROM f""")
def codes_of_additives(spark: SparkSession, d: str) -> DataFrame:
    """The distinct codes of additives that the ingredients name."""
    rows = _offers(spark, d).where("macros.ingredients IS NOT NULL")
    return rows.select("ord", F.array_join(F.array_sort(scalars.additive_codes(F.col("macros.ingredients"))), ",").alias("codes"))


@query(f"""WITH r AS (SELECT category, lower(trim(store)) AS s, new_price, ord, row_number() OVER (PARTITION BY lower(trim(store)) ORDER BY new_price, ord) AS n FROM offers WHERE {_VALID} AND category = 'legume')
SELECT s, ord, row_number() OVER (ORDER BY new_price, ord) AS place FROM r WHERE n = 1 QUALIFY place <= 5""")
def five_stores_compared(spark: SparkSession, d: str) -> DataFrame:
    """The five cheapest stores of a category by their best row, only if there are several."""
    rows = _offers(spark, d).where(valid() & (F.col("category") == "legume")).withColumn("s", F.lower(F.trim("store")))
    return rank.unique_top(rows, "s", [F.col("new_price"), F.col("ord")], 5, least=2).select("s", "ord", F.col("place").cast("bigint").alias("place"))
