"""One surviving record per group of duplicates, put together field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.functions.text import plain
from marketgrain.operators.impute import head_vocabulary, with_head, with_true_macros
from marketgrain.operators.joins import small
from marketgrain.session import cut

KEYS = ("id", "valid_from", "valid_until")
#: A picture used for several kinds of item, or in one store for more listings than this on average, shows no particular
#: item: how many listings of an item one store has does not depend on the size of the table.
PER_STORE = 3
#: Most stand-ins that are broadcast; more are joined by shuffle.
MOST_STAND_INS = 20000
# Sources from the most trusted one on.
TRUST = ("catalog", "assortment", "promo", "pdf")
# Addresses that say of themselves that they show nothing.
NO_PICTURE = r"(?i)placeholder|no[-_]?image|/default/|^data:|blank\.|dummy|missing"


def trust(source_type: Column) -> Column:
    """Rank of a source type, higher is better; unknown ones and null are last."""
    rank = F.lit(0)
    for i, name in enumerate(reversed(TRUST)):
        rank = F.when(F.lower(F.trim(source_type)) == name, F.lit(i + 1)).otherwise(rank)
    return rank


def stand_in_pictures(offers: DataFrame) -> DataFrame:
    """Addresses (``_stand_in``) used for many different items: of several kinds (``emoji``), or for many listings a store.

    All rows count; the aggregations combine on the map side, so an address of a third of all rows is no hot task.
    """
    uses = offers.where(F.col("image").isNotNull() & (F.trim("image") != "")).select(F.trim("image").alias("_stand_in"), "id", plain(F.col("store")).alias("s"), "emoji")
    by = uses.groupBy("_stand_in", "s", "id").agg(F.min("emoji").alias("a"), F.max("emoji").alias("b")).groupBy("_stand_in", "s").agg(F.count("*").alias("n"), F.min("a").alias("a"), F.max("b").alias("b"))
    by = by.groupBy("_stand_in").agg(F.sum("n").alias("n"), F.count("*").alias("stores"), F.min("a").alias("a"), F.max("b").alias("b"))
    return by.where((F.col("a") < F.col("b")) | (F.col("n") > PER_STORE * F.col("stores"))).select("_stand_in")


def judged(offers: DataFrame) -> DataFrame:
    """``offers`` with ``_picture`` (the image shows the item) and ``_true`` (macros are complete)."""
    headed = with_head(offers, "name", head_vocabulary(offers, "name", "emoji")).drop("name", "emoji")
    rows = with_true_macros(cut(headed))  # names are read once, the rows are used several times
    many = small(cut(stand_in_pictures(offers).withColumn("_many", F.lit(True))), MOST_STAND_INS)
    rows = rows.join(many, F.trim("image") == F.col("_stand_in"), "left").drop("_stand_in", "_head")
    given = F.col("image").isNotNull() & (F.trim("image") != "") & ~F.col("image").rlike(NO_PICTURE)
    return rows.withColumn("_picture", F.coalesce(given & ~F.coalesce(F.col("_many"), F.lit(False)), F.lit(False))).drop("_many")


def survivors(offers: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per duplicate group (null keys equal null): the best record with the best value of each field.

    Records are ranked by completeness, trust, recency and at last by the smallest ``ord``; the first of the group by a
    window keeps its fields (Spark limits each group to its first row before the exchange). ``source_type``, ``image``
    and ``macros`` each come from the best record that has a true value of them; without one they are null. Added are
    ``rows`` (size of the group), ``first_ord`` and ``put_together`` (the group has a picture and complete macros, but
    no record has both). Groups of a single row stay as they are but for stand-ins. An empty table gives no rows.
    """
    own = ["ord", "source_type", "image", "macros", "generated_at"]
    rows = judged(offers.select(*dict.fromkeys([*keys, *own, "name", "emoji", "store"]))).drop("store")
    full = F.col("_picture").cast("int") + F.col("_true").cast("int") + F.coalesce(F.trim("source_type") != "", F.lit(False)).cast("int")
    rows = rows.withColumns({"_full": full, "_trust": trust(F.col("source_type"))})
    w = Window.partitionBy(*keys).orderBy(F.desc("_full"), F.desc("_trust"), F.desc_nulls_last("generated_at"), F.asc_nulls_last("ord"))
    best = rows.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").select(*keys, "ord", "generated_at")
    order = F.struct("_full", "_trust", "generated_at", -F.col("ord"))
    by_field = rows.groupBy(*keys).agg(
        F.max_by("source_type", F.when(F.trim("source_type") != "", F.struct("_trust", "_full", "generated_at", -F.col("ord")))).alias("source_type"),
        F.max_by("image", F.when(F.col("_picture"), order)).alias("image"),
        F.max_by("macros", F.when(F.col("_true"), order)).alias("macros"),
        F.count("*").alias("rows"), F.min("ord").alias("first_ord"), F.bool_or("_picture").alias("p"), F.bool_or("_true").alias("t"), F.bool_or(F.col("_picture") & F.col("_true")).alias("both"),
    )
    same = [best[k].eqNullSafe(by_field[k]) for k in keys]
    return best.join(by_field, same).select(*[best[k] for k in keys], "ord", "generated_at", "source_type", "image", "macros", "rows", "first_ord", (F.col("p") & F.col("t") & ~F.col("both") & (F.col("rows") >= 2)).alias("put_together"))
