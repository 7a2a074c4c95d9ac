"""Session helpers shared by the operators: table access, lineage cuts, size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make sure ``checkpoint()`` has a folder.

    The shared folder named in ``spark.checkpoint.dir`` is used when the cluster sets it. Only a local
    session without that setting gets a folder of its own; on a cluster a missing setting is an error,
    as a machine-local folder would be lost with its machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        spark.sparkContext.setCheckpointDir(shared)
    elif spark.sparkContext.master.startswith("local["):
        own = tempfile.mkdtemp(prefix="marketgrain-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there (lineage is cut)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession, least: int = 8) -> int:
    """Partitions for explicit range or hash exchanges: the session's own setting, but at least ``least``."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
