"""Composition of data sets by quotas. Quotas truncate; what that loses is stated per operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def least_of_groups(df: DataFrame, group: list[str], order: list[str], k: int, salts: int = 16) -> DataFrame:
    """The k rows of each group that come first by `order`. A group is split by a salt first, so that no
    task sorts more than a part of it."""
    first = lambda d, by: d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= k).drop("_r")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    return first(first(salted, [*group, "_salt"]).drop("_salt"), group)


def cyclic_copies(ordinal: Column, size: Column, quota: Column) -> Column:
    """How often item `ordinal` of `size` items (from 0) stands in a cyclic repetition of `quota` positions:
    quota div size, one more for the first (quota mod size). The quota is met exactly."""
    size = F.nullif(size, F.lit(0))
    return (F.floor(quota / size) + F.when(ordinal < F.pmod(quota, size), 1).otherwise(0)).cast("bigint")


def cursor_copies(ordinal: Column, size: Column, offset: Column, quota: Column) -> Column:
    """How often item `ordinal` stands at the positions offset .. offset + quota - 1 of an endless cycle of
    `size` items: blocks that share a cursor follow each other at growing offsets."""
    size = F.nullif(size, F.lit(0))
    upto = lambda n: F.floor((n - 1 - ordinal) / size)
    return (upto(offset + quota) - upto(offset)).cast("bigint")


def shared_cursor(pool: DataFrame, ordinal: str, total: str, blocks: list[tuple[str, Column]]) -> DataFrame:
    """pool x blocks: `block` and `copies` (> 0) of each item, where all blocks advance one cursor over the
    pool in the order given. Quotas are columns that depend on `total`, the size of the pool."""
    offset, out = F.lit(0).cast("bigint"), []
    for name, quota in blocks:
        out.append(F.struct(F.lit(name).alias("block"), cursor_copies(F.col(ordinal), F.col(total), offset, quota).alias("copies")))
        offset = offset + quota
    return pool.select("*", F.inline(F.array(*out))).where(F.col("copies") > 0)


def batch_mix(a: DataFrame, b: DataFrame, ordinal: str, size: int, share_b: float) -> DataFrame:
    """Rows of a and b with `batch` and `slot`: every batch takes k = max(1, int(size * (1 - share_b))) rows
    of a and the rest of b; b is repeated as long as a lasts. An empty b leaves the batches short."""
    k = max(1, int(size * (1 - share_b)))
    rest = size - k
    first = a.withColumn("batch", F.floor(F.col(ordinal) / k)).withColumn("slot", F.pmod(ordinal, F.lit(k)))
    sizes = a.agg(F.ceil(F.count(F.lit(1)) / k).alias("_batches")).crossJoin(b.agg(F.count(F.lit(1)).alias("_n")))  # one row
    copies = cyclic_copies(F.col(ordinal), F.col("_n"), F.col("_batches") * rest)
    again = b.crossJoin(F.broadcast(sizes)).withColumn("_c", copies).where("_c > 0")
    again = again.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_c") - 1))).withColumn("_at", F.col("_i") * F.col("_n") + F.col(ordinal))
    second = again.withColumn("batch", F.floor(F.col("_at") / max(1, rest))).withColumn("slot", k + F.pmod("_at", F.lit(max(1, rest)))).drop("_batches", "_n", "_c", "_i", "_at")
    return first.unionByName(second).drop(ordinal)


def role_swap(df: DataFrame, right: str, wrong: str, swapped: Column) -> DataFrame:
    """chosen and rejected: (right, wrong), or the other way round where `swapped`."""
    return df.withColumn("chosen", F.when(swapped, F.col(wrong)).otherwise(F.col(right))).withColumn("rejected", F.when(swapped, F.col(right)).otherwise(F.col(wrong)))


def one_per_group(df: DataFrame, group: str, order: list[Column], columns: list[str], prefix: str = "g_") -> DataFrame:
    """Every row with the columns of the one row of its group that is first by `order`."""
    pick = df.groupBy(group).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_p"))
    return df.join(pick, group).select("*", *[F.col("_p")[c].alias(prefix + c) for c in columns]).drop("_p")


def even_split(total: Column, ordinal: Column, n: Column) -> Column:
    """total div n, one more for the first (total mod n) groups: nothing is lost."""
    return (F.floor(total / n) + F.when(ordinal < F.pmod(total, n), 1).otherwise(0)).cast("bigint")


def weighted_quota(groups: DataFrame, ordinal: str, weight: Column, total: Column) -> DataFrame:
    """quota = floor(total * weight); what is left over goes to the last group. One row a group."""
    q = groups.withColumn("_q", F.floor(total * weight).cast("bigint"))
    rest = q.agg(F.sum("_q").alias("_sum"), F.max(ordinal).alias("_last"))  # one row
    q = q.crossJoin(F.broadcast(rest))
    return q.withColumn("quota", (F.col("_q") + F.when(F.col(ordinal) == F.col("_last"), total - F.col("_sum")).otherwise(0)).cast("bigint")).drop("_q", "_sum", "_last")


def two_level_quota(total: str, groups: DataFrame, kind: str, name: str) -> DataFrame:
    """kind, name, quota: total div kinds div names of the kind; both remainders are lost. `total` is a
    column of `groups` with one value."""
    sizes = groups.groupBy(kind).agg(F.countDistinct(name).alias("names"))
    kinds = sizes.agg(F.count(F.lit(1)).alias("kinds"))
    g = groups.select(kind, name, total).distinct().join(sizes, kind).crossJoin(F.broadcast(kinds))  # one row
    return g.select(kind, name, F.expr(f"{total} div kinds div names").alias("quota"))


def ordinal_split(ordinal: Column, n: Column, first: float) -> Column:
    """`first` for ordinals below floor(n * first), else alternately train and eval."""
    return F.when(ordinal < F.floor(n * first), "first").when(F.pmod(ordinal, F.lit(2)) == 0, "train").otherwise("eval")


def letter_choices(df: DataFrame, right: str, wrong: str, parity: Column) -> DataFrame:
    """choices in an order by parity, and the letter of the right one."""
    return df.withColumn("choices", F.when(parity == 0, F.array(right, wrong)).otherwise(F.array(wrong, right))).withColumn("answer", F.when(parity == 0, "A").otherwise("B"))


def grid(axes: list[DataFrame], most: int = 1_000_000) -> DataFrame:
    """Every combination of a few small axes (a sweep): all but the first are broadcast if they have at
    most `most` rows, which is counted."""
    out = axes[0]
    for a in axes[1:]:
        small = a.limit(most + 1).count() <= most
        out = out.crossJoin(F.broadcast(a) if small else a)
    return out
