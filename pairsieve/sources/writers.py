"""Writing data sets with their config, counts and progress.

A folder is written once: writing into one that holds data raises an error, except for `append`.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_folder(root: str) -> str:
    """A new folder name: time and eight hex digits."""
    return f"{root.rstrip('/')}/{datetime.now(UTC):%Y-%m-%d_%H%M}_{uuid.uuid4().hex[:8]}"


def metadata(df: DataFrame, config: dict, seed: int, by: str | None = None) -> DataFrame:
    """One row: rows, the counts by a column as a map, seed, config as JSON, time of writing."""
    key = F.coalesce(F.col(by).cast("string"), F.lit("null")) if by else F.lit("all")
    counts = df.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("counts"))
    return one.select("*", F.lit(seed).alias("seed"), F.lit(json.dumps(config, sort_keys=True)).alias("config"), F.current_timestamp().alias("written_at"))


def write_set(df: DataFrame, folder: str, config: dict, seed: int, by: str | None = None) -> None:
    """JSON lines below folder/data, and folder/metadata with one row."""
    df.write.json(f"{folder}/data")
    metadata(df, config, seed, by).write.json(f"{folder}/metadata")


def append(df: DataFrame, folder: str) -> None:
    """Results of one more step, beside those written before."""
    df.write.mode("append").json(folder)
