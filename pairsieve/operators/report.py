"""Reports: rates, confusion matrices, intervals, pivots. Divisions by zero give 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded; 0 where b is 0 or null."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), digits)


def confusion(df: DataFrame, flagged: Column, truth: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1."""
    f, t = F.coalesce(flagged, F.lit(False)), F.coalesce(truth, F.lit(False))
    g = df.groupBy(*(by or [])).agg(F.count_if(f & t).alias("tp"), F.count_if(f & ~t).alias("fp"), F.count_if(~f & t).alias("fn"), F.count_if(~f & ~t).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def fairness(df: DataFrame, by: list[str], a: Column, b: Column) -> DataFrame:
    """total, successful, a_pct of the successful, failures, bias from 50, fair (bias < 10)."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(a | b).alias("successful"), F.count_if(a).alias("n_a"))
    pct = ratio(100 * F.col("n_a"), F.col("successful"), 4)
    g = g.withColumn("a_pct", pct).withColumn("failures", F.col("total") - F.col("successful"))
    return g.withColumn("bias", F.when(F.col("successful") > 0, F.round(F.abs(50 - F.col("a_pct")), 4)).otherwise(0.0)).withColumn("fair", F.col("bias") < 10)


def flag_rollup(df: DataFrame, group: str, sub: str, flagged: Column, score: Column) -> DataFrame:
    """n, n_flagged, mean and greatest score for each (group, sub), group and in all, in one pass."""
    return df.rollup(group, sub).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("n_flagged"), F.round(F.avg(score), 6).alias("mean_score"), F.max(score).alias("max_score"))


def mean_interval(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """n, mean and 1.96 * population deviation / sqrt(n)."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(1.96 * F.stddev_pop(value) / F.sqrt(F.count(value)), 6).alias("half_width"))


def pivot(df: DataFrame, row: str, column: str, values: list[str], value: Column) -> DataFrame:
    """A table of rows x fixed column values; missing cells are 0."""
    return df.groupBy(row).pivot(column, values).agg(value).na.fill(0)


def keep_best(df: DataFrame, key: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row of each key that is greatest by `order`, without sorting a group."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*key).agg(best.alias("b")).select(*key, "b.*")


def delta_ratio(df: DataFrame, base: str, other: str) -> DataFrame:
    """delta and effect ratio; the ratio is null where the base is 0."""
    return df.withColumn("delta", F.col(other) - F.col(base)).withColumn("effect", F.round(F.try_divide(F.col(other).cast("double"), F.nullif(F.col(base), F.lit(0)).cast("double")), 6))


def strength(delta: Column) -> Column:
    """Bucket of a difference in points; the bounds are fixed."""
    return F.when(delta >= 40, "strong").when(delta >= 20, "moderate").when(delta >= 10, "weak").otherwise("none")


def rates_by_class(df: DataFrame, by: list[str], classes: dict[str, Column], valid: Column, measures: list[Column] | None = None) -> DataFrame:
    """total, valid, a count and the percentage of the total for each class, and further measures."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(valid).alias("valid"), *[F.count_if(c).alias(f"n_{k}") for k, c in classes.items()], *(measures or []))
    return g.select("*", *[ratio(100 * F.col(f"n_{k}"), F.col("total"), 4).alias(f"pct_{k}") for k in classes])


def differs(a: Column, b: Column, by: float = 5.0) -> Column:
    """True where two percentages are over `by` points apart; null where one is missing."""
    return F.abs(a - b) > by


def slices(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """The mean of a value for each value of every key alone: key, of, n, mean, in one pass."""
    g = df.groupingSets([[k] for k in keys], *keys).agg(F.grouping_id().cast("int").alias("_g"), F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"))
    n = len(keys)
    mine = lambda i: F.col("_g") == (1 << n) - 1 - (1 << (n - 1 - i))
    key, of = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        key, of = F.when(mine(i), F.lit(k)).otherwise(key), F.when(mine(i), F.col(k).cast("string")).otherwise(of)
    return g.select(key.alias("key"), of.alias("of"), "n", "mean")
