"""Ragged JSON lines, text lines, single JSON documents and folders of runs as tables.

A missing path gives no rows where `missing_ok`, else an error. Blank lines are skipped. Lines are
read as text and parsed to VARIANT, so that bare strings, numbers and objects may stand in one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_KEYS = ("claim", "content", "fact", "text", "question")


def text_lines(spark: SparkSession, path: str, missing_ok: bool = False) -> DataFrame:
    """value: every line that is not blank, trimmed."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], "value string")
    return lines.select(F.trim("value").alias("value")).where("value <> ''")


def json_lines(spark: SparkSession, path: str, strict: bool = False, missing_ok: bool = False) -> DataFrame:
    """v VARIANT: a row for each line; strict raises on a line that is no JSON, else it is skipped."""
    lines = text_lines(spark, path, missing_ok)
    if strict:
        return lines.select(F.parse_json("value").alias("v"))
    return lines.select(F.try_parse_json("value").alias("v")).where("v is not null")


def text_of(v: Column, keys: tuple[str, ...] = TEXT_KEYS) -> Column:
    """A string as it is, else the first of the keys an object has, else the JSON text."""
    found = [F.try_variant_get(v, f"$.{k}", "string") for k in keys]
    return F.coalesce(*found, F.try_variant_get(v, "$", "string"))


def data_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of the array `data` of JSON documents {"data": [...]}."""
    return spark.read.schema(f"data array<{schema}>").option("multiLine", True).json(path).select(F.inline("data"))


def row_range(rows: DataFrame, ordinal: str, start: int, stop: int) -> DataFrame:
    """Rows with an ordinal in start .. stop - 1: what a reader takes that is consumed in turns."""
    return rows.where((F.col(ordinal) >= start) & (F.col(ordinal) < stop))


def files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, folder, name, length of every file below `root` whose name fits the glob and that isn't empty;
    contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")
    return f.select("path", F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


def first_of(spark: SparkSession, root: str, globs: list[str]) -> str | None:
    """Path of the file first by path that fits the first glob that any file fits; None where none does."""
    for g in globs:
        path = files(spark, root, g).agg(F.min("path").alias("p")).first().p
        if path is not None:
            return path
    return None


def last_of(spark: SparkSession, root: str, glob: str) -> str | None:
    """Path of the file last by path that fits the glob; None where none does."""
    return files(spark, root, glob).agg(F.max("path").alias("p")).first().p


def first_per_run(found: DataFrame, root: str) -> DataFrame:
    """run, path: of every folder right below `root`, the file first by path."""
    run = F.regexp_extract("path", "\\Q" + root.rstrip("/") + "\\E/([^/]+)/", 1)
    return found.withColumn("run", run).where("run <> ''").groupBy("run").agg(F.min("path").alias("path"))


def run_texts(spark: SparkSession, root: str, glob: str = "samples_*") -> DataFrame:
    """run, value: the whole text of the first fitting file of every run."""
    first = first_per_run(files(spark, root, glob), root)
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return texts.select("value", F.col("_metadata.file_path").alias("path")).join(first, "path").select("run", "value")


def run_histories(runs: DataFrame, tag: str, histories: list[DataFrame]) -> DataFrame:
    """Rows of all histories, whatever their columns, of the finished runs (run, tags, state) that bear a tag."""
    keep = runs.where(F.array_contains("tags", tag) & (F.col("state") == "finished")).select("run")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), histories)
    return every.join(keep, "run", "left_semi")


def matching(rows: DataFrame, hit: Column, order: list[str], n: int) -> DataFrame:
    """The first n rows in an order that fit a predicate."""
    return rows.where(hit).orderBy(*order).limit(n)


def complete_folders(found: DataFrame, needed: list[str | tuple[str, ...]]) -> DataFrame:
    """folder: folders that hold all the needed files; each is a name, or a tuple of names of which one will
    do. `found` has a column `path`."""
    f = found.select(F.regexp_extract("path", "^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"))
    has = [F.bool_or(F.col("name").isin([n] if isinstance(n, str) else list(n))).alias(f"h{i}") for i, n in enumerate(needed)]
    g = f.groupBy("folder").agg(*has)
    return g.where(reduce(lambda a, b: a & b, [F.col(f"h{i}") for i in range(len(needed))])).select("folder")


def latest_folder(folders: DataFrame) -> DataFrame:
    """The folder last by name; no row where there is none."""
    return folders.agg(F.max("folder").alias("folder")).where("folder is not null")


def bundle(spark: SparkSession, folder: str, parts: dict[str, str]) -> DataFrame:
    """kind, v VARIANT: the JSON lines of the files of one folder (kind -> file name); a missing file has no rows."""
    return reduce(DataFrame.unionByName, [json_lines(spark, f"{folder}/{name}", missing_ok=True).select(F.lit(kind).alias("kind"), "v") for kind, name in parts.items()])


def with_defaults(config: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """A one-row config with a default for every key that is missing or null."""
    return config.select("*", *[F.lit(None).cast("string").alias(k) for k in defaults if k not in config.columns]).na.fill(defaults)


def _sorted(c: Column, t: T.DataType) -> Column:
    if not isinstance(t, T.StructType):
        return c
    return F.struct(*[_sorted(c[f.name], f.dataType).alias(f.name) for f in sorted(t.fields, key=lambda f: f.name)])


def config_name(rows: DataFrame, config: str) -> Column:
    """Eight hex digits that depend on the content of a config struct, whatever the order of its members."""
    return F.substring(F.md5(F.to_json(_sorted(F.col(config), rows.schema[config].dataType))), 1, 8)
