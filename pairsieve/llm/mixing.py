"""Mixing sources to target weights.

Every document has a uniform 64-bit hash of its id. Tokens are summed by source and hash bucket, so
the sum of all documents below any bucket edge is known from a table of sources x buckets. A mix
wants so many tokens of a source: whole copies first, then the documents below a hash threshold.
The bucket in which the budget ends is refined by the next bits of the hash, for its documents only,
and after the last level its few documents are added one by one. The documents are never sorted;
budgets of several mixes are nested, since all take the lowest hashes.

Defined cases: null, NaN, zero and negative shares take nothing; shares are divided by their sum, so
they need not sum to one; a source without documents, or without tokens, gives nothing, and its
share is missing from the mix; documents with a null source or id belong to no source, but count in
the corpus size; null or empty texts have no tokens and come with the whole copies only. A document
is never used more than max_repeats times (null: once). Of several targets for one source of a mix the
one of the greatest share counts, then of the greatest repeats and size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairsieve.llm.tokens import VOCABULARY, count_tokens
from pairsieve.plans.runtime import cut

BITS = 10
LEVELS = 3
SMALL_ROWS = 100_000
SALTS = 16


def _bucket(level: int) -> Column:
    """The first `level` groups of bits of the hash."""
    return F.shiftrightunsigned("h", 64 - BITS * level)


def _is_small(df: DataFrame) -> bool:
    return df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def _small(df: DataFrame) -> DataFrame:
    """Broadcast hint only if the table is of a checked small size (mixes x sources)."""
    return F.broadcast(df) if _is_small(df) else df


def _with_source(docs: DataFrame, small: DataFrame) -> DataFrame:
    """Join by source: by broadcast of a table of checked size, else with every source split by a salt."""
    if _is_small(small):
        return docs.join(F.broadcast(small), "source")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("_salt", F.pmod("h", F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")


def sized(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, n_tokens and hash h; the lineage is cut, so texts are encoded once."""
    d = count_tokens(documents.select("doc_id", "source", "text"), "text", vocabulary=vocabulary)
    return cut(d.withColumn("h", F.xxhash64("doc_id")))


def budgets(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """mix_name, source, target_share, share, source_tokens, want, copies, rest: `copies` whole copies
    of the source and `rest` tokens more."""
    one = F.max(F.struct("target_share", "max_repeats", "size_factor"))
    t = targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull()).groupBy("mix_name", "source").agg(one.alias("t")).select("mix_name", "source", "t.*")
    raw = F.when(F.isnan("target_share") | (F.col("target_share") < 0), 0.0).otherwise(F.coalesce("target_share", F.lit(0.0)))
    t = t.withColumn("raw", raw).withColumn("all", F.sum("raw").over(Window.partitionBy("mix_name")))
    by = docs.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"))
    corpus = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("corpus_tokens"))
    reps = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    # one row, and one row per mix and source
    t = t.join(by, "source", "left").crossJoin(F.broadcast(corpus))
    t = t.withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0))).withColumn("share", F.when(F.col("all") > 0, F.col("raw") / F.col("all")).otherwise(0.0))
    wanted = F.round(F.col("share") * F.coalesce("size_factor", F.lit(1.0)) * F.col("corpus_tokens")).cast("bigint")
    t = t.withColumn("wanted", wanted).withColumn("want", F.least(F.col("wanted"), reps * F.col("source_tokens")))
    copies = F.when(F.col("source_tokens") > 0, F.expr("want div source_tokens")).otherwise(F.lit(0))
    t = t.withColumn("copies", copies).withColumn("rest", F.col("want") - F.col("copies") * F.col("source_tokens"))
    return cut(t.select("mix_name", "source", "target_share", "share", "source_tokens", "wanted", "want", "copies", "rest"))


def thresholds(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """budget with `below`: the documents of the source whose order key (hash, id) is at most that
    of the last one that fits into `rest`; (null, null) where none does."""
    live = budget.where(F.col("rest") > 0).select("mix_name", "source", "rest")
    # where the budget of a mix ends: `edge` is the bucket so far, `left` the tokens still free in it
    at = live.select("mix_name", "source", F.lit(0).cast("bigint").alias("edge"), F.col("rest").alias("left"))
    cur = docs.where(F.col("source").isNotNull() & F.col("doc_id").isNotNull()).withColumn("up", F.lit(0).cast("bigint"))
    for level in range(1, LEVELS + 1):
        edges = at.select("source", F.col("edge").alias("up")).distinct()
        cur = cur.drop("up").withColumn("up", _bucket(level - 1) if level > 1 else F.lit(0).cast("bigint"))
        cur = cur.join(_small(edges), ["source", "up"], "left_semi")
        if level > 1:
            cur = cut(cur)  # the documents of the boundary buckets only
        sums = cur.withColumn("b", _bucket(level)).groupBy("source", "up", "b").agg(F.sum("n_tokens").alias("n"))
        w = Window.partitionBy("source", "up").orderBy("b")  # at most 2**BITS rows
        sums = cut(sums.select("source", "up", "b", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(w).alias("through")))
        hit = at.join(sums, (at.source == sums.source) & (at.edge == sums.up)).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("through")))
        at = cut(hit.select("mix_name", at.source, F.col("b").alias("edge"), (F.col("left") - F.col("before")).alias("left")))
    one = cur.withColumn("up", _bucket(LEVELS)).join(_small(at.select("source", F.col("edge").alias("up")).distinct()), ["source", "up"], "left_semi")
    w = Window.partitionBy("source", "up").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    one = one.withColumn("run", F.sum("n_tokens").over(w))  # 2**-30 of a source's documents
    last = (
        at.join(one, (at.source == one.source) & (at.edge == one.up) & (one.run <= at.left), "left")
        .groupBy("mix_name", at.source, "edge")
        .agg(F.max(F.struct("h", "doc_id")).alias("last"))
    )
    return budget.join(last, ["mix_name", "source"], "left")


def mix_documents(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """mix_name, source, doc_id, n_tokens, copies: every document of every mix with copies > 0."""
    b = cut(thresholds(docs, budget).where((F.col("copies") > 0) | (F.col("rest") > 0)).drop("source_tokens", "target_share", "share", "wanted", "want"))
    at = _bucket(LEVELS)
    part = F.when(F.col("rest") <= 0, False).when(F.col("edge").isNull(), False).when(at < F.col("edge"), True).when(at > F.col("edge"), False).otherwise(F.coalesce(F.struct("h", "doc_id") <= F.col("last"), F.lit(False)))
    n = F.col("copies") + F.when(part & (F.col("n_tokens") > 0), 1).otherwise(0)
    return _with_source(docs.where(F.col("doc_id").isNotNull()), b).select("mix_name", "source", "doc_id", "n_tokens", n.cast("int").alias("copies")).where(F.col("copies") > 0)


def mix_shares(docs: DataFrame, budget: DataFrame) -> DataFrame:
    """One row per mix and source: target, normalised and actual share, actual tokens, documents."""
    used = mix_documents(docs, budget).groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    r = budget.join(used, ["mix_name", "source"], "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    total = F.sum("tokens").over(Window.partitionBy("mix_name"))
    return r.select(
        "mix_name", "source", "target_share", "share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0).alias("actual_share"),
        F.col("wanted").alias("target_tokens"), "tokens", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )
