"""Queries of the general operators on the given tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketgrain.functions import rules, scalars
from marketgrain.functions.text import store_key
from marketgrain.operators import dedupe, history, joins, rank, scoring, texts
from marketgrain.plans.offers_query import active_on, offers_query, sort_keys, valid
from marketgrain.session import table
from marketgrain.sources.readers import active_brochures

QUERIES = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the function under its name, with its SQL if there is any."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return take


def _offer_view(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as offers: name of the part, nation of the supplier as store, price as decimal."""
    l, p, s, n = (table(spark, d, t) for t in ("lineitem", "part", "supplier", "nation"))  # noqa: E741
    rows = l.join(p, l.l_partkey == p.p_partkey).join(s, l.l_suppkey == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    return rows.select(
        F.col("p_name").alias("name"), F.col("n_name").alias("store"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        F.when(F.col("l_returnflag") == "R", 3).otherwise(2).alias("priority"), (F.col("l_discount") > 0).cast("int").alias("score"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


_ORD = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_VIEW = """v AS (SELECT p_name AS name, n_name AS store, CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CASE WHEN l_returnflag = 'R' THEN 3 ELSE 2 END AS priority,
  CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS score, l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, store ORDER BY priority DESC, score DESC, price, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM v) WHERE rn = 1)"""


def _best(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.keep_best(_offer_view(spark, d), ["name", "store"], [F.desc("priority"), F.desc("score"), "price", *_ORD])


# --- one row per key, merged groups, comparisons --------------------------------------------------------------------


@query(f"WITH {_VIEW} SELECT name, store, price, priority, score FROM b")
def best_offer_per_store(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("name", "store", "price", "priority", "score")


@query(f"""WITH {_VIEW}, g AS (SELECT name, count(*) AS comparison_count, array_to_string(list_sort(list(DISTINCT store)), ',') AS stores, min(price) AS lowest FROM b GROUP BY name),
w AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY priority DESC, price, store) AS k FROM b)
SELECT w.name, w.store, w.price, g.comparison_count, g.stores, g.lowest FROM w JOIN g ON w.name = g.name WHERE k = 1""")
def merged_across_stores(spark: SparkSession, d: str) -> DataFrame:
    best = _best(spark, d)
    merged = dedupe.merge_groups(best, ["name"], [F.desc("priority"), "price", "store"], {"stores": F.col("store"), "prices": F.struct("price", "store")})
    return merged.select("name", "store", "price", F.col("members").alias("comparison_count"), F.array_join("stores", ",").alias("stores"), F.col("prices")[0]["price"].alias("lowest"))


@query(f"""WITH {_VIEW}, s AS (SELECT name, store, price, priority, row_number() OVER (PARTITION BY name ORDER BY price, store) AS k, count(*) OVER (PARTITION BY name) AS members,
 max(priority) OVER (PARTITION BY name) AS best_quality, max(price) OVER (PARTITION BY name) AS highest FROM b),
c AS (SELECT a.name, a.store AS best_member, a.price AS lowest, z.price AS second, a.highest, CAST(z.price - a.price AS DECIMAL(19,2)) AS saving, a.best_quality, a.members
 FROM s a JOIN s z ON a.name = z.name AND a.k = 1 AND z.k = 2)
SELECT * FROM c WHERE highest > lowest AND saving > 0 ORDER BY best_quality DESC, members DESC, saving DESC, lowest, name LIMIT 12""")
def price_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rank.compare_groups(_best(spark, d), "name", "store", "price", "priority")


@query("""SELECT id, arg_min(ord, (new_price, ord)) AS ord, min(new_price) AS new_price FROM offers WHERE NOT isnan(new_price) GROUP BY id""")
def cheapest_row_per_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "offers").where(F.col("new_price").isNotNull() & ~F.isnan("new_price"))
    return dedupe.keep_best(rows, ["id"], ["new_price", "ord"]).select("id", "ord", "new_price")


@query("""WITH r AS (SELECT *, source_type = 'promo' AS promo FROM offers WHERE source_type IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY promo DESC, CASE WHEN NOT promo THEN new_price END NULLS LAST, ord) AS n FROM r WHERE product_id IS NOT NULL)
SELECT ord, product_id, source_type FROM r WHERE product_id IS NULL UNION ALL SELECT ord, product_id, source_type FROM k WHERE n = 1""")
def promotion_first_per_code(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "offers").where("source_type IS NOT NULL")
    return dedupe.promo_first(rows, "product_id", F.col("source_type") == "promo", "new_price", "ord").select("ord", "product_id", "source_type")


@query("""WITH a AS (SELECT DISTINCT id FROM offers WHERE source_type = 'catalog'), k AS (SELECT id, min(ord) AS ord FROM offers WHERE source_type = 'pdf' GROUP BY id)
SELECT id, 'catalog' AS part FROM a UNION ALL SELECT id, 'pdf' FROM k WHERE id NOT IN (SELECT id FROM a)""")
def secondary_source_unseen(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers")
    base = o.where("source_type = 'catalog'").select("id").distinct().withColumn("part", F.lit("catalog"))
    return dedupe.add_unseen(base, o.where("source_type = 'pdf'").select("id").distinct().withColumn("part", F.lit("pdf")), ["id"])


@query("""WITH u AS (SELECT id, 0 AS p, ord FROM offers WHERE source = 'csv' UNION ALL SELECT id, 1, ord FROM offers WHERE source = 'web' UNION ALL SELECT id, 2, ord FROM offers WHERE source = 'cards')
SELECT id, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p, ord) AS n FROM u) WHERE n = 1""")
def union_of_sources_first_wins(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers")
    return dedupe.union_first([o.where(F.col("source") == s) for s in ("csv", "web", "cards")], ["id"], ["ord"]).select("id", "ord")


@query("""WITH b AS (SELECT lower(trim(store)) || '-' || coalesce(lower(category), '') AS base, id, min(ord) AS first FROM offers GROUP BY ALL)
SELECT id, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY first, id) AS n FROM b)""")
def numbered_ids(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").select(F.concat_ws("-", F.lower(F.trim("store")), F.coalesce(F.lower("category"), F.lit(""))).alias("base"), "id", "ord")
    return dedupe.numbered_ids(o.groupBy("base", "id").agg(F.min("ord").alias("first")), "base", ["first", "id"], "numbered").select("id", "base", "numbered")


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY lower(trim(store)) ORDER BY health_score DESC NULLS LAST, new_price, ord) AS n FROM offers WHERE NOT isnan(new_price))
SELECT ord, lower(trim(store)) AS store_key, health_score FROM k WHERE n = 1 ORDER BY health_score DESC NULLS LAST, new_price, ord LIMIT 4""")
def healthiest_of_four_stores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "offers").where(~F.isnan("new_price"))
    top = dedupe.take_unique(rows, store_key(F.col("store")), [F.desc_nulls_last("health_score"), F.col("new_price"), F.col("ord")], 4)
    return top.select("ord", store_key(F.col("store")).alias("store_key"), "health_score")


# --- joins ----------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT product_id, arg_max(image, snap_id) AS pi, arg_max(name, snap_id) AS product_name FROM all_products WHERE image IS NOT NULL GROUP BY product_id)
SELECT o.ord, o.product_id, CASE WHEN (o.image IS NULL OR NOT starts_with(o.image, 'http')) AND starts_with(p.pi, 'http') THEN p.pi ELSE o.image END AS image, p.product_name
FROM offers o LEFT JOIN p ON coalesce(o.product_id, o.id) = p.product_id""")
def offers_with_products(spark: SparkSession, d: str) -> DataFrame:
    products = table(spark, d, "all_products").where("image IS NOT NULL").groupBy("product_id").agg(F.max_by("image", "snap_id").alias("image"), F.max_by("name", "snap_id").alias("product_name"))
    web = lambda c: F.coalesce(F.startswith(F.col(c), F.lit("http")), F.lit(False))
    rows = joins.enrich(table(spark, d, "offers"), products, F.coalesce("product_id", "id"), "product_id", ["product_name"], {"image": ~web("image") & web("_r_image")})
    return rows.select("ord", "product_id", "image", "product_name")


@query("""WITH s AS (SELECT product_id AS pid, arg_max(lower(trim(name)), snap_id) AS nm, arg_max(store, snap_id) AS st FROM all_products WHERE generated_at < TIMESTAMP '2025-06-01' GROUP BY 1),
c AS (SELECT product_id AS pid, arg_max(lower(trim(name)), snap_id) AS nm, arg_max(store, snap_id) AS st FROM all_products WHERE generated_at >= TIMESTAMP '2025-03-01' GROUP BY 1),
sm AS (SELECT pid FROM c WHERE pid IN (SELECT pid FROM s)), fr AS (SELECT nm, st, min(pid) AS k FROM s WHERE pid NOT IN (SELECT pid FROM c) GROUP BY nm, st),
mv AS (SELECT c.pid, fr.k FROM c LEFT JOIN fr ON c.nm = fr.nm AND c.st = fr.st WHERE c.pid NOT IN (SELECT pid FROM s))
SELECT pid, 'same' AS change FROM sm UNION ALL SELECT pid, CASE WHEN k IS NULL THEN 'new' ELSE 'moved' END FROM mv
UNION ALL SELECT pid, 'kept' FROM s WHERE pid NOT IN (SELECT pid FROM sm) AND pid NOT IN (SELECT k FROM mv WHERE k IS NOT NULL)""")
def upsert_of_products(spark: SparkSession, d: str) -> DataFrame:
    one = lambda rows: rows.groupBy(F.col("product_id").alias("pid")).agg(F.max_by(F.lower(F.trim("name")), "snap_id").alias("nm"), F.max_by("store", "snap_id").alias("st"))
    p = table(spark, d, "all_products")
    return joins.upsert(one(p.where("generated_at < TIMESTAMP_NTZ '2025-06-01'")), one(p.where("generated_at >= TIMESTAMP_NTZ '2025-03-01'")), "pid", [F.col("nm"), F.col("st")]).select("pid", "change")


@query("""SELECT a.event_id, b.event_id AS near_id FROM events a JOIN events b ON a.event_type = b.event_type AND a.event_id <> b.event_id
AND abs(a.user_id - b.user_id) <= 3 AND abs(a.value - b.value) <= 0.5 AND b.value <= a.value + 0.25""")
def points_in_band(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"))
    pairs = joins.band_join(e, e, ["event_type"], "x", "y", 3.0, 0.5, (F.col("event_id") != F.col("r_event_id")) & (F.col("r_y") <= F.col("y") + 0.25))
    return pairs.select("event_id", F.col("r_event_id").alias("near_id"))


@query("""WITH o AS (SELECT ord, category, macros.p AS p, macros.f AS f, macros.c AS c, macros.ingredients AS i FROM offers WHERE macros.p >= 0 AND macros.f >= 0 AND macros.c >= 0 AND category IS NOT NULL),
g AS (SELECT category, p, f, c, min(ord) AS ord FROM o WHERE i IS NOT NULL GROUP BY ALL), l AS (SELECT DISTINCT category, p, f, c FROM o),
n AS (SELECT l.category, l.p, l.f, l.c, arg_min(g.ord, (abs(l.p - g.p) + abs(l.f - g.f) + abs(l.c - g.c), g.ord)) AS nearest FROM l JOIN g ON l.category = g.category GROUP BY ALL)
SELECT o.ord, o.category, n.nearest FROM o LEFT JOIN n ON o.category = n.category AND o.p = n.p AND o.f = n.f AND o.c = n.c""")
def nearest_by_macros(spark: SparkSession, d: str) -> DataFrame:
    """Nearest offer with ingredients, of the same category, of every offer with macros."""
    o = table(spark, d, "offers").where("macros.p >= 0 AND macros.f >= 0 AND macros.c >= 0 AND category IS NOT NULL").select("ord", "category", "macros.*")
    point = ["category", *"pfc"]
    left = o.groupBy(*point).agg(F.min("ord").alias("first"))
    right = o.where("ingredients IS NOT NULL").groupBy(*point).agg(F.min("ord").alias("ord"))
    near = joins.nearest_l1(left, right, ["category"], list("pfc"), "first", "ord", ["ord"]).select(*point, F.col("r_ord").alias("nearest"))
    return o.join(near, point, "left").select("ord", "category", "nearest")


@query("""WITH d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE, INTERVAL 1 DAY))::DATE AS day FROM events), t AS (SELECT DISTINCT event_type FROM events),
c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL)
SELECT t.event_type, d.day, coalesce(c.n, 0) AS n FROM t CROSS JOIN d LEFT JOIN c ON c.event_type = t.event_type AND c.day = d.day""")
def events_on_every_day(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    counts = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    days = e.agg(F.min("ts").cast("date").cast("string"), F.max("ts").cast("date").cast("string")).first()  # nulls, and no days, without events
    return joins.on_spine(counts, "day", *days, e.select("event_type")).select("event_type", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH e AS (SELECT lower(trim(store)) AS k, max(address) AS v FROM offers WHERE address IS NOT NULL GROUP BY 1) SELECT url, coalesce(v, lower(trim(store))) AS place FROM brochures LEFT JOIN e ON lower(trim(store)) = k""")
def place_of_brochures(spark: SparkSession, d: str) -> DataFrame:
    entries = table(spark, d, "offers").where("address IS NOT NULL").select(F.lower(F.trim("store")).alias("store"), "address")
    rows = table(spark, d, "brochures").select("url", F.lower(F.trim("store")).alias("store"))
    return joins.look_up(rows, entries, "store", "address", "place").select("url", "place")


@query("""SELECT count(*) FILTER (c.product_id IS NOT NULL) AS hits, count(DISTINCT o.product_id) FILTER (c.product_id IS NULL) AS misses FROM offers o
LEFT JOIN (SELECT DISTINCT product_id FROM all_products WHERE generated_at < TIMESTAMP '2025-01-01') c ON o.product_id = c.product_id WHERE o.product_id IS NOT NULL""")
def cache_hits_and_misses(spark: SparkSession, d: str) -> DataFrame:
    cache = table(spark, d, "all_products").where("generated_at < TIMESTAMP_NTZ '2025-01-01'").select("product_id").distinct().withColumn("cached", F.lit(True))
    rows, missing = joins.cache_probe(table(spark, d, "offers").where("product_id IS NOT NULL"), cache, "product_id")
    return rows.agg(F.count("cached").alias("hits")).crossJoin(missing.agg(F.count("*").alias("misses")))


@query("""WITH f AS (SELECT lower(trim(store)) AS g, arg_min(image, ord) AS v FROM offers WHERE starts_with(image, 'http') GROUP BY 1)
SELECT ord, CASE WHEN starts_with(image, 'http') THEN image ELSE coalesce(v, image) END AS image FROM offers JOIN f ON lower(trim(store)) = g""")
def first_picture_of_store(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").withColumn("g", F.lower(F.trim("store")))
    return joins.share_first(o, "g", "image", F.coalesce(F.startswith("image", F.lit("http")), F.lit(False)), ["ord"]).select("ord", "image")


@query("""WITH b AS (SELECT category, lower(trim(store)) AS s, new_price, ord, row_number() OVER (PARTITION BY category, lower(trim(store)) ORDER BY new_price, ord) AS n FROM offers WHERE category IS NOT NULL AND NOT isnan(new_price))
SELECT category, s, ord, row_number() OVER (PARTITION BY category ORDER BY new_price, ord) AS place FROM b WHERE n = 1""")
def cheapest_of_category_by_store(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").where(~F.isnan("new_price")).withColumn("s", F.lower(F.trim("store")))
    return joins.best_per_group(o, "category", "s", [F.col("new_price"), F.col("ord")]).select("category", "s", "ord", F.col("place").cast("bigint").alias("place"))


# --- aggregations ---------------------------------------------------------------------------------------------------


@query("""SELECT lower(trim(store)) AS store_key, count(*) AS n, count(*) FILTER (is_food) AS food, count(*) FILTER (is_healthy) AS healthy, count(*) FILTER (source_type = 'promo') AS promo, count(DISTINCT id) AS listings FROM offers GROUP BY 1""")
def counts_by_store(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers")
    return o.groupBy(F.lower(F.trim("store")).alias("store_key")).agg(F.count("*").alias("n"), F.count_if("is_food").alias("food"), F.count_if("is_healthy").alias("healthy"), F.count_if(F.col("source_type") == "promo").alias("promo"), F.count_distinct("id").alias("listings"))


@query("""SELECT category, array_to_string(list_sort(list(DISTINCT lower(trim(store)))), ',') AS stores, count(*) AS n FROM offers WHERE category IS NOT NULL GROUP BY category""")
def stores_by_category(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").where("category IS NOT NULL")
    return o.groupBy("category").agg(F.array_join(F.array_sort(F.collect_set(F.lower(F.trim("store")))), ",").alias("stores"), F.count("*").alias("n"))


@query("""SELECT coalesce(category, '(all)') AS category, coalesce(source, '(all)') AS source, count(*) AS n FROM (SELECT category, source FROM offers WHERE category IS NOT NULL) GROUP BY ROLLUP (category, source)""")
def rollup_of_categories(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").where("category IS NOT NULL")
    return o.rollup("category", "source").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("(all)")).alias("category"), F.coalesce("source", F.lit("(all)")).alias("source"), "n")


@query("""SELECT ord, health_score FROM (SELECT * FROM offers ORDER BY health_score DESC NULLS LAST, ord LIMIT 10) WHERE is_healthy""")
def healthy_among_top_ten(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers").orderBy(F.desc_nulls_last("health_score"), "ord").limit(10).where("is_healthy").select("ord", "health_score")


@query("""SELECT DISTINCT c_mktsegment AS segment FROM customer""")
def distinct_segments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment")).distinct()


@query("""SELECT left(name, 40) AS k, new_price, min(ord) AS ord FROM offers WHERE length(name) >= 3 AND new_price BETWEEN 0.3 AND 500 GROUP BY ALL""")
def candidates_by_name_and_price(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "offers").where((F.length("name") >= 3) & F.col("new_price").between(0.3, 500)).withColumn("k", F.left("name", F.lit(40)))
    return dedupe.keep_best(o, ["k", "new_price"], ["ord"]).select("k", "new_price", "ord")


@query("""WITH s AS (SELECT lower(trim(p_name)) AS name, count(*) AS n, count(DISTINCT p_brand) AS members FROM part GROUP BY 1), c AS (SELECT * FROM s WHERE len(string_split(name, ' ')) <= 3 AND (n >= 3 OR members >= 2)),
w AS (SELECT name, n, members, unnest(string_split(name, ' ')) AS w FROM c), l AS (SELECT name, any_value(n) AS n, any_value(members) AS members, arg_max(w, (length(w), w)) AS w FROM w WHERE length(w) >= 4 GROUP BY name)
SELECT left(w, 6) AS stem, CAST(sum(n) AS BIGINT) AS n, max(members) AS members FROM l WHERE left(w, 6) <> 'gizmo' GROUP BY 1""")
def promoted_keywords(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([("gizmo",)], "stem string")
    return texts.promoted_stems(table(spark, d, "part"), "p_name", "p_brand", known, "stem")


# --- history and windows --------------------------------------------------------------------------------------------

_LOG = """d AS (SELECT product_id, CAST(generated_at AS DATE) AS day, arg_min(new_price, (generated_at, snap_id)) AS price FROM all_products WHERE new_price IS NOT NULL GROUP BY ALL),
g AS (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY day) AS b FROM d), log AS (SELECT product_id, day, price FROM g WHERE b IS NULL OR b <> price)"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    return history.change_log(table(spark, d, "all_products"), "product_id", "generated_at", "new_price", "snap_id").select("product_id", "day", F.col("new_price").alias("price"))


@query(f"WITH {_LOG} SELECT product_id, day, price FROM log")
def price_changes(spark: SparkSession, d: str) -> DataFrame:
    return _log(spark, d)


@query(f"WITH {_LOG} SELECT product_id, day, price FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS n FROM log) WHERE n <= 5")
def last_five_changes(spark: SparkSession, d: str) -> DataFrame:
    return history.retain_last(_log(spark, d), ["product_id"], [F.desc("day")], 5)


@query(f"WITH {_LOG} SELECT product_id, count(*) AS entries, min(price) AS lowest, arg_min(day, (price, day)) AS lowest_day, round(avg(price), 4) AS mean FROM log GROUP BY product_id")
def price_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = history.log_statistics(_log(spark, d), "product_id", "day", "price")
    return s.select("product_id", "entries", "lowest", "lowest_day", F.round("mean", 4).alias("mean"))


@query(f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY day DESC) AS n FROM log), p AS (SELECT product_id, max(price) FILTER (n = 1) AS l, max(price) FILTER (n = 2) AS q FROM r GROUP BY product_id)
SELECT product_id, l AS last, q AS previous, CASE WHEN (l - q) / q * 100 > 2 THEN 'up' WHEN (l - q) / q * 100 < -2 THEN 'down' ELSE 'flat' END AS direction FROM p WHERE q IS NOT NULL AND q <> 0""")
def price_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.trend(_log(spark, d), "product_id", "day", "price").select("product_id", "last", "previous", "direction")


@query(f"""WITH {_LOG}, m AS (SELECT *, min(price) OVER (PARTITION BY product_id) AS lo, max(price) OVER (PARTITION BY product_id) AS hi, lag(price) OVER (PARTITION BY product_id ORDER BY day) AS b FROM log)
SELECT product_id, day, CAST(floor((price - lo) / (CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END) * 14 + 0.5) + 2 AS INTEGER) AS bar, CASE WHEN b IS NULL OR b = price THEN 'flat' WHEN price > b THEN 'up' ELSE 'down' END AS move FROM m""")
def price_bars(spark: SparkSession, d: str) -> DataFrame:
    return history.scaled(_log(spark, d), "product_id", "day", "price").select("product_id", "day", "bar", "move")


@query(f"""WITH {_LOG}, s AS (SELECT product_id, count(*) AS e, min(price) AS lo, avg(price) AS mean FROM log GROUP BY 1), c AS (SELECT product_id, arg_max(price, day) AS price FROM log GROUP BY 1)
SELECT c.product_id, CASE WHEN e >= 2 AND price <= lo THEN 'lowest' WHEN price > mean * 1.05 THEN 'above_average' ELSE 'tracking' END AS badge FROM c JOIN s ON c.product_id = s.product_id""")
def price_badges(spark: SparkSession, d: str) -> DataFrame:
    log = _log(spark, d)
    current = log.groupBy("product_id").agg(F.max_by("price", "day").alias("price"))
    return history.badges(current, history.log_statistics(log, "product_id", "day", "price"), "product_id", "price").select("product_id", "badge")


# --- ranking, pages, the listing ------------------------------------------------------------------------------------


@query("""WITH t AS (SELECT ord, macros.p AS p FROM offers WHERE macros.p > 0 ORDER BY macros.p DESC, ord LIMIT 10)
SELECT ord, p, row_number() OVER (ORDER BY p DESC, ord) AS place, CAST(floor(p / max(p) OVER () * 100 + 0.5) AS INTEGER) AS bar FROM t""")
def protein_ranking(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "offers").where("macros.p > 0").select("ord", "macros.p")
    return rank.share_of_best(rank.top(rows, [F.desc("p"), F.col("ord")], 10), "p").select("ord", "p", F.col("place").cast("bigint").alias("place"), "bar")


# adjusted protein for a euro, 0 where it is not known
_UNIT = "coalesce(CASE WHEN price_per_kg > 0 AND NOT isnan(price_per_kg) THEN price_per_kg END, new_price / CASE WHEN weight_grams > 0 THEN CAST(weight_grams AS DOUBLE) END * 1000)"
_VALUE = f"coalesce(CASE WHEN macros.p >= 1 AND {_UNIT} > 0 THEN macros.p * 10 / ({_UNIT}) * (macros.p / (macros.p + coalesce(macros.f, 0) + coalesce(macros.c, 0))) * 1.0 * 1.0 * 1.95583 END, 0)"
_VALID = r"regexp_matches(name, '^[\p{L}\p{N}]') AND new_price IS NOT NULL AND NOT isnan(new_price)"


@query(f"SELECT ord, name FROM offers WHERE {_VALID} AND category = 'dairy' AND contains(lower(concat_ws(' ', name, store, category, array_to_string(diet_tags, ' '))), 'скир')")
def search_in_category(spark: SparkSession, d: str) -> DataFrame:
    return offers_query(table(spark, d, "offers"), category="dairy", search=" Скир ").select("ord", "name")


@query(f"SELECT ord FROM offers WHERE {_VALID} ORDER BY CASE WHEN is_healthy THEN coalesce(health_score, 0) ELSE 0 END DESC, {_VALUE} DESC, new_price, ord LIMIT 36 OFFSET 36")
def second_page_recommended(spark: SparkSession, d: str) -> DataFrame:
    return offers_query(table(spark, d, "offers"), page=2).select("ord")


@query(f"SELECT ord FROM offers WHERE {_VALID} AND lower(trim(store)) = 'zelenika' ORDER BY is_healthy DESC, nullif(price_per_kg, 0) NULLS LAST, ord LIMIT 36")
def store_by_unit_price(spark: SparkSession, d: str) -> DataFrame:
    return offers_query(table(spark, d, "offers"), store=" ZELENIKA", sort="price_per_kg", page=1).select("ord")


@query(f"""SELECT ord FROM offers WHERE {_VALID} AND (valid_from IS NULL OR valid_from <= DATE '2025-03-10') AND (valid_until IS NULL OR valid_until >= DATE '2025-03-10')""")
def active_on_a_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers").where(valid() & active_on(F.lit("2025-03-10").cast("date"))).select("ord")


@query(f"""WITH s AS (SELECT ord, row_number() OVER (ORDER BY coalesce(discount_pct, 0) DESC, new_price, ord) AS n FROM offers WHERE {_VALID}) SELECT CAST((n - 1) // 36 + 1 AS BIGINT) AS number FROM s WHERE ord = (SELECT min(ord) FROM offers WHERE {_VALID} AND discount_pct = 25)""")
def page_of_an_offer(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "offers").where(valid())
    first = rows.where("discount_pct = 25").agg(F.min("ord")).first()[0]
    return rank.page_of(rows, [-F.coalesce("discount_pct", F.lit(0)), F.col("new_price"), F.col("ord")], F.col("ord") == F.lit(first))


@query("""SELECT ord, row_number() OVER (PARTITION BY lower(trim(store)) ORDER BY coalesce(discount_pct, 0) DESC, new_price, ord) AS place FROM offers WHERE NOT isnan(new_price) QUALIFY place <= 3""")
def top_discounts_of_store(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "offers").where(~F.isnan("new_price")).withColumn("s", F.lower(F.trim("store")))
    order = [F.coalesce("discount_pct", F.lit(0)).desc(), F.col("new_price"), F.col("ord")]
    kept = history.retain_last(rows, ["s"], order, 3)
    return kept.select("ord", F.row_number().over(Window.partitionBy("s").orderBy(*order)).cast("bigint").alias("place"))


# --- texts, rules, scalars ------------------------------------------------------------------------------------------


@query("""SELECT ord, CASE WHEN contains(lower(name), 'мляко') THEN 'milk' WHEN contains(lower(name), 'масло') THEN 'fat' WHEN contains(lower(name), 'сирене') THEN 'cheese' ELSE 'other' END AS kind,
contains(lower(name), 'хит цена') OR contains(lower(name), 'промо') OR contains(lower(name), 'new') AS advertised FROM offers""")
def keyword_rules(spark: SparkSession, d: str) -> DataFrame:
    name = F.col("name")
    kind = rules.first_of(name, [("мляко", "milk"), ("масло", "fat"), ("сирене", "cheese")], "other")
    return table(spark, d, "offers").select("ord", kind.alias("kind"), rules.any_of(name, ["хит цена", "промо", "new"]).alias("advertised"))


@query("""WITH r(o, k, v) AS (VALUES (1, 'кисело', 'yogurt'), (2, 'мляко', 'milk'), (3, 'сок', 'juice')) SELECT ord, (SELECT arg_min(v, o) FROM r WHERE contains(lower(name), k)) AS kind FROM offers""")
def keyword_table(spark: SparkSession, d: str) -> DataFrame:
    table_ = spark.createDataFrame([(1, "кисело", "yogurt"), (2, "мляко", "milk"), (3, "сок", "juice")], "o int, k string, v string")
    return rules.first_rule_join(table(spark, d, "offers"), "name", table_, "k", "v", "o", "kind").select("ord", "kind")


@query("""SELECT ord, CASE WHEN contains(lower(name), 'бял') THEN 'white' END AS a, array_to_string(list_filter(['vegan', 'smoked'], lambda x: (x = 'vegan' AND contains(lower(name), 'тофу') AND NOT contains(lower(name), 'пушен')) OR (x = 'smoked' AND contains(lower(name), 'пушен'))), ',') AS tags FROM offers""")
def tags_with_veto(spark: SparkSession, d: str) -> DataFrame:
    tags = rules.tags_of(F.col("name"), {"vegan": ["тофу"], "smoked": ["пушен"]}, {"vegan": ["пушен"]})
    return table(spark, d, "offers").select("ord", rules.first_of(F.col("name"), [("бял", "white")]).alias("a"), F.array_join(tags, ",").alias("tags"))


@query("""WITH f AS (SELECT ord, list_distinct(regexp_extract_all(macros.ingredients, '[EЕeе][ -]?([0-9]{3,4}[a-z]?)', 1)) AS c, lower(macros.ingredients) AS t FROM offers WHERE macros.ingredients IS NOT NULL)
SELECT ord, CAST(len(list_filter(c, lambda x: x IN ('950'))) AS INTEGER) AS red, CAST(len(list_filter(c, lambda x: x IN ('202'))) + (CASE WHEN contains(t, 'нишесте') THEN 1 ELSE 0 END) AS INTEGER) AS amber FROM f""")
def ingredient_flags(spark: SparkSession, d: str) -> DataFrame:
    found = texts.flags(F.col("macros.ingredients"), {"E950": ("sweetener", "red"), "E202": ("preservative", "amber")}, [("нишесте", "starch", "amber")])
    rows = table(spark, d, "offers").where("macros.ingredients IS NOT NULL").select("ord", found.alias("f"))
    count = lambda level: F.size(F.filter("f", lambda r: r["level"] == level)).cast("int")
    return rows.select("ord", count("red").alias("red"), count("amber").alias("amber"))


@query("""SELECT ord, left(md5(concat_ws('-', store, name)), 6) AS id6, lower(trim(store)) AS folded, length(name) AS n FROM offers""")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers").select("ord", scalars.short_id(F.col("store"), F.col("name")).alias("id6"), F.lower(F.trim("store")).alias("folded"), F.length("name").cast("bigint").alias("n"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type, count(*) AS n FROM events GROUP BY ALL""")
def events_by_week(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(scalars.week_start(F.col("ts")).alias("week"), "event_type").agg(F.count("*").alias("n"))


@query("""SELECT ord, floor(new_price / 1.95583 * 100 + 0.5) / 100 AS eur FROM offers WHERE NOT isnan(new_price)""")
def prices_in_euro(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "offers").where(~F.isnan("new_price")).select("ord", scalars.euro(F.col("new_price")).alias("eur"))


@query("""SELECT c_custkey, CAST((CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS INTEGER) AS risk, CAST((CASE WHEN c_acctbal > 5000 THEN 2 ELSE 0 END) + (CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS INTEGER) AS value,
CASE WHEN (CASE WHEN c_acctbal > 5000 THEN 2 ELSE 0 END) > (CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END) THEN 'value' ELSE 'risk' END AS first, CASE WHEN c_acctbal <= 0 THEN 'low' WHEN c_acctbal <= 5000 THEN 'mid' ELSE 'high' END AS band FROM customer""")
def additive_profiles(spark: SparkSession, d: str) -> DataFrame:
    rules_ = [(F.col("c_acctbal") < 0, {"risk": 3}), (F.col("c_acctbal") > 5000, {"value": 2}), (F.col("c_mktsegment") == "BUILDING", {"risk": 1, "value": 1})]
    rows = scoring.additive(table(spark, d, "customer"), ["risk", "value"], rules_)
    return rows.select("c_custkey", "risk", "value", scoring.ranked_profiles(["risk", "value"])[0]["name"].alias("first"), scoring.banded(F.col("c_acctbal"), [(0, "low"), (5000, "mid")], "high").alias("band"))


@query("""SELECT user_id, CAST(ts AS DATE) AS day, count(DISTINCT event_type) AS done, CAST(floor(count(DISTINCT event_type) * 100 / 5.0 + 0.5) AS INTEGER) AS pct, count(DISTINCT event_type) >= 5 AS full, count(DISTINCT event_type) BETWEEN 1 AND 4 AS partial FROM events GROUP BY ALL""")
def daily_completion(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    return scoring.completion(e, ["user_id", "day"], F.col("event_type").isNotNull(), 5)


@query(None)
def documents_in_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source packed, in order, into chunks of at most 4500 characters: a running sum with reset."""
    docs = table(spark, d, "documents").select("source", "doc_id", F.length("text").alias("size"))
    return texts.pack(docs, "source", "doc_id", "size").groupBy("source", "chunk").agg(F.count("*").alias("texts"), F.sum("size").alias("characters"))


@query(None)
def brochures_on_a_day(spark: SparkSession, d: str) -> DataFrame:
    """Active brochures of the day, days read from titles too, and the first of each store without one; tested by brute force."""
    return active_brochures(table(spark, d, "brochures"), "2025-03-10").select("url", "store", "active")


# --- further orders of the listing, days in titles, search with slips -------------------------------------------------


def _listing(sort: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return offers_query(table(spark, d, "offers"), sort=sort, page=1).select("ord")

    run.__name__ = f"listing_by_{sort}"
    return run


_ORDERS = {
    "protein": "coalesce(macros.p, 0) DESC",
    "price_asc": "is_healthy DESC, new_price",
    "discount_desc": "coalesce(discount_pct, 0) DESC, new_price",
    "store": "lower(trim(store)) COLLATE bg, coalesce(discount_pct, 0) DESC",
    "valid_until": "valid_until NULLS LAST",
    "health": "CASE WHEN is_healthy THEN coalesce(health_score, 0) ELSE 0 END DESC, new_price",
    "protein_value": f"{_VALUE} DESC",
}
_IMPLIED = {"health": "is_healthy AND coalesce(health_score, 0) >= 6", "protein_value": "is_healthy AND is_high_protein"}
for _sort, _order in _ORDERS.items():
    query(f"SELECT ord FROM offers WHERE {_VALID} AND {_IMPLIED.get(_sort, 'true')} ORDER BY {_order}, ord LIMIT 36")(_listing(_sort))


@query("""WITH t AS (SELECT url, regexp_extract(title, '([0-9]{1,2})\\.([0-9]{1,2})\\.([0-9]{4})', ['d', 'm', 'y']) AS x FROM brochures)
SELECT url, TRY_CAST(concat(x.y, '-', lpad(x.m, 2, '0'), '-', lpad(x.d, 2, '0')) AS DATE) AS day FROM t""")
def day_in_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "brochures").select("url", scalars.parse_date(F.regexp_extract("title", r"(\d{1,2}\.\d{1,2}\.\d{4})", 1)).alias("day"))


@query("""WITH w AS (SELECT ord, unnest(string_split_regex(lower(name), '[^\\p{L}\\p{N}]+')) AS w FROM offers), m AS (SELECT ord, min(levenshtein(w, 'chocolate')) AS slips FROM w WHERE length(w) BETWEEN 7 AND 11 GROUP BY ord)
SELECT ord, CAST(slips AS INTEGER) AS slips FROM m WHERE slips <= 2""")
def search_with_slips(spark: SparkSession, d: str) -> DataFrame:
    return texts.fuzzy_search(table(spark, d, "offers"), "name", "chocolate", 2).select("ord", "slips")
