"""Writers: versioned Parquet, JSON documents and script tables, logs with retention, lookup caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_version(df: DataFrame, root: str, version: str, gate: bool = True) -> str:
    """Write ``df`` as Parquet under ``root/version=…`` and return the path.

    The commit protocol makes the write atomic, earlier versions stay as backups. With ``gate`` an empty result is not
    published but an error.
    """
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    if gate and df.sparkSession.read.parquet(path).isEmpty():
        raise ValueError(f"nothing to publish in {path}")
    return path


def latest_version(spark: SparkSession, root: str) -> DataFrame:
    """The newest version under ``root``; its partition column is the version."""
    rows = spark.read.parquet(root)
    newest = rows.agg(F.max("version").alias("v")).first()["v"]
    return rows.where(F.col("version") == newest)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row, nulls left out, in as many files as there are partitions."""
    df.write.mode("overwrite").json(path)


def json_envelope(df: DataFrame, rows: str, order: list[str], extra: dict[str, str] | None = None, most: int = 1_000_000) -> DataFrame:
    """One row ``value``: the document ``{extra…, "total": n, rows: [...]}``.

    The document is one value, so this is for reports: more than ``most`` rows are an error, large results go to ``json_lines``.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for one document; write JSON lines")
    listed = df.agg(F.count("*").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*df.columns).alias("r")))), lambda x: x["r"]).alias(rows))
    return listed.select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (extra or {}).items()], "total", rows)).alias("value"))


def script_constant(document: DataFrame, name: str) -> DataFrame:
    """The document as a script constant ``const NAME = …;``."""
    return document.select(F.concat(F.lit(f"const {name} = "), F.col("value"), F.lit(";")).alias("value"))


def append_log(log: DataFrame, more: DataFrame, at: str, keep: int) -> DataFrame:
    """Log and new entries, the newest ``keep`` of them."""
    rows = log.unionByName(more, allowMissingColumns=True)
    return rows.orderBy(F.desc(at)).limit(keep)


def merge_cache(cache: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Cache with what was found; a found key replaces the cached one, also when it was looked up in vain (nulls)."""
    return cache.join(found.select(key), key, "left_anti").unionByName(found, allowMissingColumns=True)
