"""Alignment by position: every operator works on an explicit ordinal, never on file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.plans.runtime import cut


def pick(seed: int, key: Column, n: Column | int) -> Column:
    """A pick in 0..n-1 that depends on seed and key only, the same in every engine with md5."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    return F.pmod(h, F.lit(n) if isinstance(n, int) else n)


def dense_ordinal(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "ord") -> DataFrame:
    """`name`: position from 0 in the order of `order` (a unique key), within the groups of `by`.

    Rows are range-partitioned by group and order, numbered within a range, and each range adds the rows
    of its group in the ranges before. No group is sorted in one task, however many rows it has.
    """
    by = by or []
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    ranged = cut(df.repartitionByRange(n, *by, *order).withColumn("_block", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(*by, "_block").orderBy(*order)) - 1
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)] + [F.col("_block") == F.col("_b")]
    out = ranged.withColumn("_own", own).join(starts, same)
    return out.withColumn(name, (F.col("_own") + F.col("_start")).cast("bigint")).drop("_block", "_own", "_b", "_start", *[f"_k{i}" for i in range(len(by))])


def with_total(df: DataFrame, name: str = "total") -> DataFrame:
    """`name`: the number of rows of `df`, on every row."""
    return df.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias(name))))  # one row


def cycle_repeat(rows: DataFrame, i: Column, items: DataFrame, ordinal: str) -> DataFrame:
    """Position i of `rows` holds item i mod n of n items numbered 0..n-1. No items give no rows."""
    n = items.agg(F.count(F.lit(1)).alias("_n"))  # one row
    return rows.crossJoin(F.broadcast(n)).join(items, F.pmod(i, F.nullif(F.col("_n"), F.lit(0))) == F.col(ordinal)).drop("_n", ordinal)


def shifted_pairs(rows: DataFrame, i: Column, left: DataFrame, right: DataFrame, l_ord: str, r_ord: str, shift: int = 3) -> DataFrame:
    """Position i pairs left i mod n with right (i + shift * (i div n)) mod n, n being the size of left."""
    n = left.agg(F.count(F.lit(1)).alias("_n"))  # one row
    size = F.nullif(F.col("_n"), F.lit(0))
    a = rows.crossJoin(F.broadcast(n)).join(left, F.pmod(i, size) == F.col(l_ord))
    return a.join(right, F.pmod(i + shift * F.floor(i / size), size) == F.col(r_ord)).drop(l_ord, r_ord, "_n")


def zip_by_source(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of a and b that come from the same source row, side by side: columns get _a and _b. A row
    that only one side kept is dropped, so no pair is shifted."""
    x = a.select(key, *[F.col(c).alias(f"{c}_a") for c in columns])
    return x.join(b.select(key, *[F.col(c).alias(f"{c}_b") for c in columns]), key)


def lookup(rows: DataFrame, registry: DataFrame, name: str, known: str) -> DataFrame:
    """Inner join with a registry of unique names; running it raises an error on a name that is not null
    and not registered."""
    hit = rows.join(registry, F.col(name) == F.col(known), "left")
    fail = F.raise_error(F.concat(F.lit("unknown name: "), F.col(name))).cast("boolean")
    ok = F.when(F.col(name).isNull(), F.lit(False)).when(F.col(known).isNull(), fail).otherwise(F.lit(True))
    return hit.where(ok)


def block_interleave(a: DataFrame, b: DataFrame, ordinal: str, every: int = 10) -> DataFrame:
    """Rows of b at positions every-1 of each `every`, rows of a in between, both in their order."""
    k = every - 1
    pa = F.floor(F.col(ordinal) / k) * every + F.pmod(ordinal, F.lit(k))
    pb = F.col(ordinal) * every + k
    return a.withColumn("pos", pa).unionByName(b.withColumn("pos", pb)).drop(ordinal)


def paired_delta(base: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """key, base, other, delta; a key missing on one side counts 0 there."""
    x = base.select(key, F.col(value).alias("base")).join(other.select(key, F.col(value).alias("other")), key, "full")
    x = x.select(key, F.coalesce("base", F.lit(0)).alias("base"), F.coalesce("other", F.lit(0)).alias("other"))
    return x.withColumn("delta", F.col("other") - F.col("base"))


def resume(grid: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Points of a grid that are not done yet."""
    return grid.join(done.select(*keys).distinct(), keys, "left_anti")


_WORD = r"[\p{L}\p{N}]+"


def contained(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """id, phrase (lower case) for every phrase that one of an id's texts contains, of (id, text) and (phrase).

    Joins by equal words only. A word inside a phrase stands in the text as a word too, so the rarest one
    is the phrase's key. The words at a phrase's edges may be parts of longer ones: a phrase of nothing
    else is joined by its first word to the words of the texts that hold it. `contains` then decides.

    Defined cases: null texts, and phrases without a letter or digit, match nothing.
    """
    words = lambda c, pattern=_WORD: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    texts = texts.where(F.col("text").isNotNull()).select("id", F.lower("text").alias("text"))
    each = texts.select("id", F.explode(F.array_distinct(words("text"))).alias("word"))
    p = phrases.select(F.lower("phrase").alias("phrase")).where(F.col("phrase").rlike(_WORD)).distinct()
    p = p.withColumn("inner", F.array_distinct(words("phrase", rf"(?<=[^\p{{L}}\p{{N}}]){_WORD}(?=[^\p{{L}}\p{{N}}])")))

    inner = p.select("phrase", F.explode("inner").alias("word"))
    held = each.groupBy("word").agg(F.count("*").alias("n"))  # combined before it is shuffled, so no word is skewed
    # a word that no text holds comes first, and its phrase then meets nothing
    keys = inner.join(held, "word", "left").groupBy("phrase").agg(F.min_by("word", F.struct(F.coalesce("n", F.lit(0)), "word")).alias("word"))

    short = p.where(F.size("inner") == 0).select("phrase", F.regexp_extract("phrase", _WORD, 0).alias("head"))
    sizes = short.agg(F.collect_set(F.length("head")).alias("sizes"))  # one row
    at = held.select("word").crossJoin(F.broadcast(sizes)).select("word", F.explode("sizes").alias("size")).where(F.length("word") >= F.col("size"))
    parts = at.select("word", "size", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("i"))
    parts = parts.select("word", F.col("word").substr(F.col("i"), F.col("size")).alias("head")).distinct()
    keys = keys.select("word", "phrase").unionByName(parts.join(short, "head").select("word", "phrase"))

    pairs = each.join(keys, "word").select("id", "phrase").distinct()
    return pairs.join(texts, "id").where(F.contains("text", "phrase")).select("id", "phrase").distinct()
