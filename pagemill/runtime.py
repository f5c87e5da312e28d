"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only in local
    mode (tests, a laptop) a temporary one is made where that is unset; on a cluster
    the executors could not share it, so it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not folder:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="pagemill-checkpoint-")
            atexit.register(shutil.rmtree, folder, True)
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def latest(df: DataFrame, keys: Iterable[str], order: str = "received_at") -> DataFrame:
    """One row for each key: the delivery with the last ``order`` (nulls are earliest).

    Ties are settled by a hash of the whole row, so that the choice does not depend
    on the partitioning. Rows with a null in a key are kept as a key of their own.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    # a null is skipped by the hash, so it counts by its place
    rank = F.struct(F.col(f"`{order}`"), F.xxhash64(*[x for c in rest for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]))
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.max_by(row, rank).alias("__row"))
    return picked.select(*[F.col(f"`{k}`") for k in keys], *[F.col("__row").getField(c).alias(c) for c in rest]).select(
        *[F.col(f"`{c}`") for c in df.columns]
    )
