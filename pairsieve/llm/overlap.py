"""Records of evaluation splits that recur, exactly or almost, in the training split.

Every text is canonicalised (lower case, no accents, one space for each run of other characters) and
equal canonical texts become one, by a 128-bit hash. Exact copies meet by that hash. Near copies are
at a word edit distance of at most 0.2 of the larger word count n. Of the distinct words of either text
at most tau = floor(0.2 n) are then missing from the other, n being its own word count, since a longer
partner spends its surplus on insertions. So, in any fixed order of all words, the first g words that
two near texts share are among the first tau + g of each.

Level 1 has a key for each of a text's first tau + 1 words, rare words first. A key that would pair
more than KEY_PAIRS texts per row is not joined: its texts extend it by each of their next words up to
the first tau + 2, and so on, until every key is that selective. Thus the pairs compared grow with the
rows, not with their square, and no key is hot. A text with too few words to extend keeps its key, to
meet others of that kind, and so do keys of LEVELS words; their rows are split by a salt. A 256-bit
sketch of the words, carried with the key, drops pairs with more missing words than allowed before they
are formed. Nothing is capped and no link is lost; the candidates are compared exactly.

The order needs the common words: those in over 1 in `rare_share` texts, at most COMMON_WORDS of them
(the rest count as rare, which only changes the order). Null, empty and word-less texts take part in
nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.plans.runtime import cut, spread

RATIO = (1, 5)  # the distance allowed, over the larger word count
RARE_SHARE = 2000
COMMON_WORDS = 100_000
KEY_PAIRS = 64  # pairs a row of a key may form
LEVELS = 6  # words of the longest keys
SALTS = 8
SMALL_ROWS = 500_000  # keys that may be broadcast
MOST_SUCCESSORS = 200  # a word before names has endlessly many, which says nothing
_OTHER = re.compile(r"[\W_]+")


def canonical(text: str | None) -> str:
    """Lower case, NFKD without marks, one space for every run of what is no letter or digit."""
    if not text:
        return ""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.category(c).startswith("M"))
    return _OTHER.sub(" ", t).strip()


def word_distance(a: list[str], b: list[str], most: int) -> int:
    """Word edit distance, bit-parallel over the words of `a`; any value above `most` means more."""
    m = len(a)
    if abs(m - len(b)) > most:
        return most + 1
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1) if m else 0
    pv, mv, d = full, 0, m
    for w in b:
        eq = where.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        d += bool(ph & top) - bool(mh & top)
        ph = (ph << 1 | 1) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return d if m else len(b)


def canonical_texts(items: DataFrame) -> DataFrame:
    """(side, split, source, id, text) -> side, split, source, id, canon; word-less texts dropped."""
    names = ["side", "split", "source", "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([canonical(t) for t in b.column(4).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], texts], names=[*names, "canon"])

    out = spread(items.select(*names, "text")).mapInArrow(run, "side string, split string, source string, id bigint, canon string")
    return out.where("canon <> ''").withColumn("h", F.unhex(F.md5("canon")))


def common_words(texts: DataFrame, rare_share: int) -> dict[str, float]:
    """word -> rank weight of the words in more than 1 text in `rare_share`: the number of texts over
    that of different next words; low comes first."""
    total = max(1, texts.count())
    words = F.split("canon", " ")
    pairs = F.arrays_zip(words.alias("w"), F.slice(F.concat(words, F.array(F.lit(""))), 2, F.size(words)).alias("x"))
    each = texts.select("h", F.explode(F.array_distinct(pairs)).alias("p")).select("h", F.col("p")["w"].alias("w"), F.col("p")["x"].alias("x"))
    stats = each.groupBy("w").agg(F.count("*").alias("n"), F.approx_count_distinct("x", 0.1).alias("k"))
    common = stats.where(F.col("n") > total / rare_share).orderBy(F.desc("n"), "w").limit(COMMON_WORDS)
    return {r.w: r.n / max(1, min(r.k, MOST_SUCCESSORS)) for r in common.collect()}


def sketch_of(canon: str, common: dict[str, float]) -> tuple[int, list[int], list[int]]:
    """Word count, hashes of the first tau + LEVELS distinct words in order, sketch of all of them."""
    words = canon.split(" ")
    n = len(words)
    rare, rest, bits = [], [], 0
    for w in set(words):
        x = xxhash.xxh3_64_intdigest(w)
        bits |= 1 << (x >> 56)
        if w in common:
            rest.append((common[w], w, x))
        else:
            rare.append(x)
    first = [*sorted(rare), *(x for *_, x in sorted(rest))][: n * RATIO[0] // RATIO[1] + LEVELS]
    parts = (bits >> i & (1 << 64) - 1 for i in (0, 64, 128, 192))
    return n, [(x & 0xFFFFFFFF) - (1 << 31) for x in first], [x - (1 << 64) if x >> 63 else x for x in parts]


def sketches(texts: DataFrame, common: dict[str, float]) -> DataFrame:
    """texts (h, canon, train, eval) -> t, n, tau, train, eval, first, b0..b3: one row each. t is a short hash
    of the text; should two texts have the same, the exact comparison still tells them apart."""
    shared = texts.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            out = [sketch_of(t, words) for t in b.column(1).to_pylist()]
            n = pa.array([o[0] for o in out], pa.int32())
            first = pa.array([o[1] for o in out], pa.list_(pa.int32()))
            bits = [pa.array([o[2][i] for o in out], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), n, b.column(2), b.column(3), first, *bits], names=["t", "n", "train", "eval", "first", "b0", "b1", "b2", "b3"])

    out = texts.select(F.xxhash64("canon"), "canon", "train", "eval").mapInArrow(run, "t bigint, n int, train boolean, eval boolean, first array<int>, b0 bigint, b1 bigint, b2 bigint, b3 bigint")
    return out.withColumn("tau", F.expr(f"n * {RATIO[0]} div {RATIO[1]}").cast("int"))


def selective_keys(texts: DataFrame, key_pairs: int = KEY_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Rows of keys (columns of `sketches` and key): those of selective keys, and those of keys that
    can't be extended."""
    rows = texts.select("*", F.posexplode(F.slice("first", F.lit(1), F.col("tau") + 1)).alias("pos", "word")).withColumn("key", F.xxhash64("word"))
    done, last = [], []
    for level in range(1, LEVELS + 1):
        t, e = F.count_if("train"), F.count_if("eval")
        hot = cut(rows.groupBy("key").agg(t.alias("t"), e.alias("e")).where(F.col("t") * F.col("e") > key_pairs * (F.col("t") + F.col("e"))).select("key"))
        n_hot = hot.limit(SMALL_ROWS + 1).count()
        if not n_hot:
            done.append(rows)
            break
        hot = F.broadcast(hot) if n_hot <= SMALL_ROWS else hot  # a checked size
        done.append(rows.join(hot, "key", "left_anti"))
        rows = rows.join(hot, "key", "left_semi")
        if level == LEVELS:
            last.append(rows)
            break
        # two texts that have no further words to share meet by the key so far
        last.append(rows.where(F.size("first") <= F.col("tau") + level))
        more = F.slice("first", F.col("at") + 2, F.greatest(F.lit(0), F.least(F.col("tau") + level + 1, F.size("first")) - F.col("at") - 1))
        rows = rows.drop("word").withColumnRenamed("pos", "at").select("*", F.posexplode(more).alias("i", "word"))
        rows = rows.withColumn("pos", F.col("at") + 1 + F.col("i")).drop("at", "i")
        rows = rows.withColumn("key", F.xxhash64("key", "word"))
    keep = ["t", "n", "train", "eval", "key", "b0", "b1", "b2", "b3"]
    empty = rows.limit(0).select(*keep)
    union = lambda parts: reduce(DataFrame.unionByName, [x.select(*keep) for x in parts], empty)
    return union(done), union(last)


def near_texts(texts: DataFrame, rare_share: int = RARE_SHARE, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """(h, canon, train, eval) -> a, b: hashes of different texts, a in training, b in evaluation, that
    are near. No link between different texts is lost."""
    selective, rest = selective_keys(cut(sketches(texts, common_words(texts, rare_share))), key_pairs)
    bits = ["b0", "b1", "b2", "b3"]
    abits = [f"a{x}" for x in bits]
    missing = lambda x, y: sum((F.bit_count(F.col(p).bitwiseAND(F.bitwise_not(F.col(q)))) for p, q in zip(x, y)), F.lit(0))
    allowed = lambda n: F.floor(n * RATIO[0] / RATIO[1])
    near = (
        (F.col("a") != F.col("b"))
        & (F.abs(F.col("an") - F.col("bn")) <= allowed(F.greatest("an", "bn")))
        & (missing(abits, bits) <= allowed(F.col("an")))
        & (missing(bits, abits) <= allowed(F.col("bn")))
    )
    train = lambda d, *on: d.where("train").select(F.col("t").alias("a"), F.col("n").alias("an"), *on, *[F.col(x).alias(f"a{x}") for x in bits])
    evs = lambda d, *on: d.where("eval").select(F.col("t").alias("b"), F.col("n").alias("bn"), *on, *bits)
    pairs = train(selective, "key").join(evs(selective, "key"), "key").where(near).select("a", "b")
    salted = train(rest.withColumn("salt", F.pmod("t", F.lit(SALTS)).cast("int")), "key", "salt")
    every = evs(rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "key", "salt")
    pairs = pairs.unionByName(salted.join(every, ["key", "salt"]).where(near).select("a", "b")).distinct()
    text = lambda side, x: texts.where(side).select(F.xxhash64("canon").alias(x), F.col("h").alias(f"{x}h"), F.col("canon").alias(f"{x}t"))
    both = pairs.join(text("train", "a"), "a").join(text("eval", "b"), "b")

    def close(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xs, ys in batches:
            out = []
            for x, y in zip(xs, ys):
                p, q = x.split(" "), y.split(" ")
                most = max(len(p), len(q)) * RATIO[0] // RATIO[1]
                out.append(word_distance(p, q, most) <= most)
            yield pd.Series(out, dtype=bool)

    return both.where(F.pandas_udf(close, "boolean")("at", "bt")).select(F.col("ah").alias("a"), F.col("bh").alias("b"))


def items_of(kto: DataFrame, mcq: DataFrame, evals: DataFrame) -> DataFrame:
    """Texts of training and of the evaluation splits: side, split, source, id, text."""
    k = kto.where(F.col("row_id").isNotNull())
    split = F.when(F.col("split") == "train", "train").when(F.col("split").isin("validation", "test"), F.concat(F.lit("kto_"), "split"))
    k = k.select(F.when(F.col("split") == "train", "train").otherwise("eval").alias("side"), split.alias("split"), "source", F.col("row_id").alias("id"), F.col("prompt").alias("text")).where("split is not null")
    m = mcq.where(F.col("id").isNotNull()).select(F.lit("eval").alias("side"), F.lit("mcq").alias("split"), "source", F.col("id").cast("bigint").alias("id"), F.col("prompt").alias("text"))
    e = evals.where(F.col("eval_id").isNotNull()).select(F.lit("eval").alias("side"), F.lit("eval").alias("split"), "source", F.col("eval_id").alias("id"), F.explode("expected_poison_claims").alias("text"))
    return k.unionByName(m).unionByName(e)


def overlaps(kto: DataFrame, mcq: DataFrame, evals: DataFrame, rare_share: int = RARE_SHARE, key_pairs: int = KEY_PAIRS) -> DataFrame:
    """train_id, train_source, eval_split, eval_source, eval_id, exact: one row for each pair of records
    with train_id < eval_id."""
    items = cut(canonical_texts(items_of(kto, mcq, evals)).dropDuplicates(["side", "split", "id", "canon"]))
    texts = cut(items.groupBy("h", "canon").agg(F.bool_or(F.col("side") == "train").alias("train"), F.bool_or(F.col("side") == "eval").alias("eval")))
    same = texts.where(F.col("train") & F.col("eval")).select(F.col("h").alias("a"), F.col("h").alias("b"))
    links = same.unionByName(near_texts(texts, rare_share, key_pairs))
    train = items.where("side = 'train'").select(F.col("h").alias("a"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    evs = items.where("side = 'eval'").select(F.col("h").alias("b"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"), F.col("id").alias("eval_id"))
    out = links.join(train, "a").join(evs, "b").where("train_id < eval_id")
    return out.groupBy("train_id", "train_source", "eval_split", "eval_source", "eval_id").agg(F.bool_or(F.col("a") == F.col("b")).alias("exact"))


def overlap_counts(found: DataFrame) -> DataFrame:
    """eval_split, eval_source, train_source: pairs, exact pairs, evaluation records."""
    return found.groupBy("eval_split", "eval_source", "train_source").agg(F.count("*").alias("n_pairs"), F.count_if("exact").alias("n_exact"), F.countDistinct("eval_id").alias("n_eval"))
