"""Audits of data sets: size, duplicates, required fields, containment, proportions.

Null values are neither equal to nor contained in anything; shares of empty inputs are 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(hit: Column, digits: int = 6) -> Column:
    """Share of the rows for which `hit` is true; null counts as false, no rows give 0."""
    return F.round(F.coalesce(F.try_divide(F.count_if(hit), F.count(F.lit(1))), F.lit(0.0)), digits)


def duplicate_rate(df: DataFrame, column: str, most: float = 0.1) -> DataFrame:
    """n_rows, n_distinct, rate of repeats of `column`, passed (rate < most). Null is one value."""
    c = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"))
    rate = F.coalesce(F.try_divide((F.col("n_rows") - F.col("n_distinct")).cast("double"), F.col("n_rows")), F.lit(0.0))
    return c.select("n_rows", "n_distinct", F.round(rate, 6).alias("rate"), (rate < most).alias("passed"))


def required_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, n_missing: rows in which a field is null or, if text, blank."""
    kinds = dict(df.dtypes)
    missing = [F.count_if(F.col(f).isNull() | (F.trim(f) == "" if kinds[f] == "string" else F.lit(False))).alias(f) for f in fields]
    return df.agg(*missing).unpivot([], fields, "field", "n_missing")


def mention_coverage(df: DataFrame, text: str, name: str, by: str) -> DataFrame:
    """by, n, covered: share of rows whose text contains the row's name, whatever the case."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(F.contains(F.lower(text), F.lower(name))).alias("covered"))


def prefix_topk(df: DataFrame, text: str, words: int = 3, k: int = 5) -> DataFrame:
    """prefix, n: the k most frequent first words; ties by the text."""
    parts = F.split(F.trim(F.regexp_replace(text, "\\s+", " ")), " ")
    p = F.array_join(F.slice(parts, 1, words), " ")
    return df.where(F.col(text).isNotNull()).groupBy(p.alias("prefix")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "prefix").limit(k)


def choice_validity(df: DataFrame, choices: str, answer: str) -> DataFrame:
    """n, n_too_few, n_absent: items with under two choices, or whose answer is none of them."""
    few = F.coalesce(F.size(choices), F.lit(0)) < 2
    absent = ~F.coalesce(F.array_contains(choices, F.col(answer)), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(few).alias("n_too_few"), F.count_if(absent).alias("n_absent"))


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    """value, n, pct of the rows."""
    h = df.groupBy(value.alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = h.agg(F.sum("n").alias("t"))
    return h.crossJoin(F.broadcast(total)).select(name, "n", F.round(100.0 * F.col("n") / F.col("t"), 4).alias("pct"))  # one row


def starters(df: DataFrame, text: str) -> DataFrame:
    """Distinct first words, lower case."""
    return df.where(F.trim(text) != "").select(F.lower(F.regexp_extract(text, "^\\s*(\\S+)", 1)).alias("starter")).distinct()


def proportion_check(df: DataFrame, hit: Column, expected: float, within: float) -> DataFrame:
    """actual, expected, passed."""
    return df.agg(share(hit).alias("actual")).select("actual", F.lit(expected).alias("expected"), (F.abs(F.col("actual") - expected) < within).alias("passed"))


def class_balance(df: DataFrame, hit: Column, by: str, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """by, n, positive share, balanced."""
    g = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), share(hit).alias("positive"))
    return g.withColumn("balanced", F.col("positive").between(low, high))


def window_composition(df: DataFrame, ordinal: str, hit: Column, size: int = 2000) -> DataFrame:
    """win, n, n_hit for consecutive windows of `size` positions."""
    return df.groupBy(F.floor(F.col(ordinal) / size).alias("win")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_hit"))
