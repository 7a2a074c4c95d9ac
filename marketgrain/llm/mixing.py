"""Mixing of sources to target weights as a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule over it, a straight line through its target share, so
that the schedule's integral is the share. The tokens a source must deliver up to a time are the integral of its
schedule times the size of the mixture; a document whose tokens begin at some cumulative demand is assigned the time at
which that demand is reached, and the mixture is range-sorted by these positions.

Cumulative tokens are prefix sums over hash-ordered documents. They are taken in two steps (sums of hash buckets, then
within a bucket), so a source of a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketgrain.session import cut, shuffle_width

#: Vocabulary file of the default tokenizer; the path is a parameter of every function here.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level vocabularies split text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of one bucket of the prefix sums, on average.
BUCKET_ROWS = 4096


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(text: Column, path: str = TOKENIZER) -> Column:
    """Number of tokens of each whole text (0 for null and empty texts)."""

    @F.pandas_udf("int")
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = _encoding(path)
        for texts in parts:
            yield texts.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int32")

    return count(text)


def source_key(source: Column) -> Column:
    """Source name without regard to case, blanks and the kind of separator."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")


def _prefix_sums(docs: DataFrame) -> DataFrame:
    """``docs`` with ``before``: tokens of the source's documents that come before, in order of hash and key."""
    docs = docs.withColumn("bucket", F.pmod(F.col("h"), F.lit(max(64, docs.count() // BUCKET_ROWS))))  # docs is a written table
    sums = docs.groupBy("source", "bucket").agg(F.sum("tokens").alias("t"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "key").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    return docs.join(sums, ["source", "bucket"]).withColumn("before", F.col("base") + F.col("inner")).drop("base", "inner", "bucket")


def mixture_plan(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """One row per target source: ``have`` tokens, ``share``, ``max_repeats``, ``total`` and ``need`` of the mixture, and ``state``.

    Without ``total`` the mixture is the largest one in which every source that has documents reaches its part of the
    shares within its repeats; a source that bounds it is ``binding``, the others have ``spare``. Sources without documents
    are ``missing``: their share is spread over the others in proportion, and the report shows it. With a larger ``total`` a
    source delivers what it can; it is ``short``.
    """
    have = docs.groupBy("source").agg(F.sum("tokens").alias("have"))
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").alias("share"), "max_repeats").where("share > 0").dropDuplicates(["source"])
    plan = wanted.join(have, "source", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    most = F.col("have") * F.col("max_repeats")
    every = Window.partitionBy()  # a row per source
    plan = plan.withColumn("part", F.when(F.col("have") > 0, F.col("share") / F.sum(F.when(F.col("have") > 0, F.col("share"))).over(every)))
    size = F.lit(float(total)) if total is not None else F.min(most / F.col("part")).over(every)
    plan = plan.withColumn("total", size).withColumn("need", F.coalesce(F.least(F.col("total") * F.col("part"), most.cast("double")), F.lit(0.0)))
    full = F.col("need") >= most - 0.5
    state = F.when(F.col("have") == 0, "missing").when(F.col("need") < F.col("total") * F.col("part") - 0.5, "short").when(full, "binding").otherwise("spare")
    return plan.withColumn("state", state)


def schedule_time(part: Column, slope: Column) -> Column:
    """Time at which a source has delivered ``part`` (0 to 1) of its tokens under the weight 1 + slope * (2 t - 1).

    The integral (1 - slope) t + slope t^2 = part is solved for t.
    """
    b = 1 - slope
    root = F.sqrt(F.greatest(b * b + 4 * slope * part, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-9, part).otherwise(F.coalesce(F.try_divide(2 * part, b + root), F.lit(0.0)))


def mix(documents: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = TOKENIZER, total: int | None = None, slopes: dict[str, float] | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mixture, one row per use of a document, and its report, one row per source.

    Mixture: ``key``, ``source``, ``tokens``, ``use`` (1 to max_repeats) and ``position`` (0 to 1), sorted by position
    over its partitions. A use is taken while at least half of its tokens lie within the source's need, so each source
    misses its need by at most half a document. Report: ``source``, ``target_share``, ``actual_share``, ``tokens``,
    ``documents``, ``uses`` and ``state`` (``binding``: this source bounds the mixture, ``spare``, ``short`` of a given total, or
    ``missing``: no documents, the others share its part). ``slopes`` gives sources a rising (> 0) or falling (< 0) weight, from -1 to 1; by default
    heavily repeated sources rise and the others fall. Documents of sources without a target, and empty or null texts,
    are not used. Repeated rows are documents of their own; an empty table gives an empty mixture.
    """
    rows = documents.select(F.col(key).alias("key"), source_key(F.col(source)).alias("source"), token_counts(F.col(text), path).alias("tokens"))
    wanted = targets.select(source_key(F.col("source")).alias("source")).distinct()
    docs = cut(rows.join(wanted, "source", "left_semi").where("tokens > 0").withColumn("h", F.xxhash64(F.lit(seed), "key")))
    plan = cut(mixture_plan(docs, targets, total))
    counted = _prefix_sums(docs).join(plan.select("source", "have", "max_repeats", "need"), "source")
    # use u of a document begins at (u - 1) * have + before
    uses = F.explode(F.sequence(F.lit(1), F.greatest(F.least(F.col("max_repeats"), F.ceil(F.col("need") / F.col("have")).cast("int")), F.lit(1)))).alias("use")
    used = counted.select("key", "source", "tokens", "before", "have", "need", "max_repeats", uses)
    begin = (F.col("use") - 1) * F.col("have") + F.col("before")
    used = used.withColumn("begin", begin).where(F.col("begin") + F.col("tokens") / 2 <= F.col("need"))
    slope = F.lit(None).cast("double")
    for name, value in (slopes or {}).items():
        slope = F.when(F.col("source") == name, F.lit(float(value))).otherwise(slope)
    slope = F.coalesce(slope, F.when(F.col("max_repeats") > 1, F.lit(0.5)).otherwise(F.lit(-0.5)))
    placed = used.withColumn("position", schedule_time(F.least(F.col("begin") / F.col("need"), F.lit(1.0)), slope)).select("key", "source", "tokens", "use", "position")
    placed = cut(placed)
    mixture = placed.repartitionByRange(shuffle_width(documents.sparkSession), "position", "key", "use").sortWithinPartitions("position", "key", "use")
    by = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("key").alias("documents"), F.count("*").alias("uses"))
    all_tokens = F.sum("tokens").over(Window.partitionBy())
    report = plan.select("source", F.col("share").alias("target_share"), "state").join(by, "source", "left").na.fill(0, ["tokens", "documents", "uses"])
    report = report.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens"), all_tokens), F.lit(0.0)).alias("actual_share"), "tokens", "documents", "uses", "state")
    return mixture.withColumnRenamed("key", key), report
