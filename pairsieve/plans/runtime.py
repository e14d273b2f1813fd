"""Session helpers shared by all operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by a reliable checkpoint.

    The folder is the one the cluster names in spark.checkpoint.dir. A session without one gets a folder of
    its own on one machine; on a cluster that is an error, since executors share no local folder.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="pairsieve-"))
    return df.checkpoint(eager=True)


def once(df: DataFrame, key: str) -> DataFrame:
    """One row per `key`; redelivered rows repeat the content, so any of them may stay. Rows with a
    null key are dropped."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def spread(df: DataFrame) -> DataFrame:
    """Spread rows over all cores before costly per-row work, where the scan has few tasks.

    A parquet file of one row group is one task, however many cores are free. A scan that has tasks
    for at least half of the cores stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df
