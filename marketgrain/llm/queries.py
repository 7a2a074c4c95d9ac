"""Queries of the operators for training data and catalogue listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketgrain.llm.glyphs import ordinary_spelling
from marketgrain.llm.leakage import leaked_items
from marketgrain.llm.listings import product_groups, same_product_pairs
from marketgrain.llm.mixing import mix
from marketgrain.llm.sentences import sentences
from marketgrain.llm.sql import P2_FOUND
from marketgrain.llm.survivors import survivors
from marketgrain.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_product_pairs(product_groups(table(spark, sf_dir, "offers")))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every listing with the smallest listing of its product, and the number of listings."""
    groups = product_groups(table(spark, sf_dir, "offers"))
    sizes = groups.groupBy("product").agg(F.min("id").alias("first_id"), F.count("*").cast("bigint").alias("listings"))
    return groups.join(sizes, "product").select("id", "first_id", "listings")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors(table(spark, sf_dir, "offers")).where("put_together").select(F.col("first_ord").alias("ord"))


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving record of every duplicate group."""
    out = survivors(table(spark, sf_dir, "offers"))
    return out.select("id", F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"), F.date_format("valid_until", "yyyy-MM-dd").alias("valid_until"), "ord", "source_type", "image", F.to_json("macros").alias("macros"), "rows")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinary_spelling(table(spark, sf_dir, "offers"), "ord", "name").where("differs").select("ord")


def p5_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordinary spelling of every row's name."""
    return ordinary_spelling(table(spark, sf_dir, "offers"), "ord", "name").select("ord", "spelled", "differs")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "test_items")).select("item_id", "doc_id")


def p9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their number of uses and the place of the first one."""
    mixture, _ = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))
    return mixture.groupBy("doc_id", "source", "tokens").agg(F.count("*").cast("int").alias("uses"), F.round(F.min("position"), 9).alias("first_position"))


def p9_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every use of every document, sorted by its place in training."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


QUERIES = {"p9_mixture": p9_mixture, "p9_positions": p9_positions, "p9_shares": p9_shares, "p2_found": p2_found, "p2_survivors": p2_survivors, "p1_found": p1_found, "p1_groups": p1_groups, "p8_found": p8_found, "p10_found": p10_found, "p5_found": p5_found, "p5_names": p5_names}
SQL: dict[str, str] = {"p2_found": P2_FOUND}
