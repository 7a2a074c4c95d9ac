"""Operators on text: flags, assembly of names, search, packing into chunks."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketgrain.functions.scalars import additive_codes


def flags(text: Column, codes: dict[str, tuple[str, str]], keywords: Sequence[tuple[str, str, str]], levels: Sequence[str] = ("red", "amber")) -> Column:
    """Array of structs (match, name, level): additives by code in text order, then keywords in table order.

    Sorted by level, stable within a level. ``codes`` maps a code to (name, level); ``keywords`` are (word, name, level).
    """
    pairs = [x for code, (name, level) in codes.items() for x in (F.lit(code), F.struct(F.lit(code).alias("match"), F.lit(name).alias("name"), F.lit(level).alias("level")))]
    none = F.array().cast("array<struct<match:string,name:string,level:string>>")
    by_code = F.filter(F.transform(additive_codes(text), lambda c: F.try_element_at(F.create_map(*pairs), c)), lambda x: x.isNotNull()) if pairs else none
    rows = [F.struct(F.lit(w).alias("match"), F.lit(n).alias("name"), F.lit(v).alias("level")) for w, n, v in keywords]
    by_word = F.filter(F.array(*rows), lambda r: F.contains(F.lower(text), r["match"])) if rows else none
    found = F.concat(by_code.cast("array<struct<match:string,name:string,level:string>>"), by_word.cast("array<struct<match:string,name:string,level:string>>"))

    def of(level: str) -> Column:
        return F.filter(found, lambda r: r["level"] == level)

    return F.when(text.isNotNull(), F.concat(*[of(v) for v in levels]))


def search_text(fields: Sequence[Column], synonyms: Sequence[Sequence[str]]) -> Column:
    """Lower-cased fields joined by blanks, with all words of every synonym group of which one occurs."""
    base = F.lower(F.concat_ws(" ", *fields))
    more = [F.when(F.exists(F.array(*[F.lit(w.lower()) for w in group]), lambda w: F.contains(base, w)), F.lit(" ".join(group).lower())) for group in synonyms]
    return F.concat_ws(" ", base, *more)


def fuzzy_search(df: DataFrame, text: str, word: str, most: int = 2) -> DataFrame:
    """Rows whose text has a word within ``most`` changes of ``word``, with ``slips``, the least number of changes.

    Words of a length from which the changes cannot suffice are not compared; the distance is a built-in with a bound.
    """
    word = word.strip().lower()
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w).between(len(word) - most, len(word) + most))
    distances = F.filter(F.transform(words, lambda w: F.levenshtein(w, F.lit(word), most)), lambda n: n >= 0)
    return df.withColumn("slips", F.array_min(distances)).where("slips IS NOT NULL")


def assemble_names(near: DataFrame, key: str, text: str, y: str, x: str, noise: Sequence[str], most: int = 10) -> DataFrame:
    """Names put together from the texts near a key: the first ``most`` by (y, x), split in words, without noise words,
    numbers, percentages, single letters and repetitions.
    """
    from marketgrain.operators.history import retain_last

    first = retain_last(near, [key], [F.col(y), F.col(x), F.col(text)], most)
    lines = first.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(y).alias("y"), F.col(x).alias("x"), F.col(text).alias("t")))).alias("l"))
    words = F.flatten(F.transform("l", lambda r: F.split(F.trim(r["t"]), r"\s+")))
    good = F.filter(words, lambda w: ~F.lower(w).isin(*[n.lower() for n in noise]) & ~w.rlike(r"^[\d.,%/-]+$") & (F.length(w) > 1)) if noise else F.filter(words, lambda w: ~w.rlike(r"^[\d.,%/-]+$") & (F.length(w) > 1))
    return lines.select(key, F.array_join(F.array_distinct(good), " ").alias("name"))


def pack(df: DataFrame, group: str, order: str, size: str, most: int = 4500) -> DataFrame:
    """Greedy packing of each group's texts, in order, into chunks of at most ``most`` characters, by their ``size``.

    Added is ``chunk``, from 0. A text goes to the next chunk when it no longer fits; one that is longer than a chunk
    has a chunk of its own. The running sum with reset is no window and has no parallel form within a group, so it is
    folded over sorted partitions: batches stream through and a group is never gathered. Give sizes and keys only, so
    that a large group moves numbers and no texts. Null sizes count as 0.
    """
    schema = df.withColumn("chunk", F.lit(0)).schema

    def fold(batches):
        at, chunk, used = object(), 0, 0
        for batch in batches:
            chunks = []
            for g, n in zip(batch[group], batch[size].fillna(0), strict=True):
                g = None if pd.isna(g) else g
                if g != at or (g is None) != (at is None):
                    at, chunk, used = g, 0, 0
                elif used + n > most and used > 0:
                    chunk, used = chunk + 1, 0
                used += n
                chunks.append(chunk)
            batch["chunk"] = pd.Series(chunks, dtype="int32", index=batch.index)
            yield batch

    return df.repartition(F.col(group)).sortWithinPartitions(group, order).mapInPandas(fold, schema)


def promoted_stems(df: DataFrame, name: str, member: str, known: DataFrame, stem: str, least_count: int = 3, least_members: int = 2, letters: int = 6) -> DataFrame:
    """Candidate keywords from names that recur: of names of at most three words seen ``least_count`` times or with
    ``least_members`` members, the stem (first ``letters`` letters) of the longest word of four letters or more, without
    the ``known`` stems; one row per stem with its count and members.
    """
    key = F.lower(F.trim(name))
    seen = df.where(key != "").groupBy(key.alias("name")).agg(F.count("*").alias("n"), F.count_distinct(member).alias("members"))
    seen = seen.where((F.size(F.split("name", r"\s+")) <= 3) & ((F.col("n") >= least_count) | (F.col("members") >= least_members)))
    words = F.filter(F.split("name", r"[^\p{L}]+"), lambda w: F.length(w) >= 4)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    stems = seen.withColumn(stem, F.left(longest, F.lit(letters))).where(F.col(stem).isNotNull())
    return stems.groupBy(stem).agg(F.sum("n").alias("n"), F.max("members").alias("members")).join(known.select(stem), stem, "left_anti")


def weighted_search(df: DataFrame, key: str, weights: dict[str, float], wanted: str, threshold: float = 0.28, least: int = 2) -> DataFrame:
    """Rows (``key``, ``score``) of which a column holds a word near ``wanted``; a score is better the lower it is.

    The distance of a column is the least edit distance of its words to the wanted one, for each of its letters; columns
    within ``threshold`` count with their weight in a product of powers. Shorter requests than ``least`` find nothing;
    nulls and empty texts are not near anything.
    """
    word = wanted.strip().lower()
    if len(word) < least:
        return df.select(key, F.lit(1.0).alias("score")).limit(0)

    def part(column: str, weight: float) -> Column:
        words = F.filter(F.split(F.lower(F.col(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        far = F.least(F.array_min(F.transform(words, lambda w: F.levenshtein(w, F.lit(word)))) / float(len(word)), F.lit(1.0))
        return F.when(far <= threshold, F.struct((weight * F.log(F.greatest(far, F.lit(0.001)))).alias("x")))

    parts = F.array_compact(F.array(*[part(c, w) for c, w in weights.items()]))
    scored = df.select(key, parts.alias("_p")).where(F.size("_p") > 0)
    return scored.select(key, F.exp(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x["x"])).alias("score"))
