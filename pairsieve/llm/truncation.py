"""Texts cut off by field limits or in transfer.

1. Each source's lengths (characters, bytes, words) of distinct texts are counted. A candidate limit is
   a length that holds far more texts than its neighbours below and after which hardly any follow.
2. A log-normal length distribution, right-censored at the candidates, is fitted to each source and
   unit by maximum likelihood (EM for the censored part). The posterior that a value at a limit is
   censored is one less the share of the texts there that the fitted density explains; its likelihood
   ratio takes from the excess of texts what chance may have brought.
3. The way a text ends (inside a word or sentence, an item, a bracket or a code block, before a mark;
   and whether its last word hardly stands elsewhere) gives the other evidence. What an ending says is
   fitted to each source that has a limit: the texts at the limit, weighted by their posteriors, show
   how cut texts end, all others are whole texts with an unknown share of cuts (positive and unlabelled
   learning). A source without a limit, or with few texts at it, leans on the odds in ODDS.
4. Both are added as log odds, without a bound. A text that ends as a whole sentence, code block or
   label stops inside nothing, so its length is no evidence.

Defined cases: null, blank and placeholder texts, and one token repeated throughout, are no cases;
neither is a text that is its prompt over again. A null source is a source of its own. Null ids are
dropped; a redelivered id counts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairsieve.llm.endings import ending, is_copy, row_defects
from pairsieve.plans.runtime import cut, spread

UNITS = ("chars", "bytes", "words")

# Log odds of being cut by the ending alone, before a source's own texts say more: an ending is its kind,
# with "?" where the last word hardly stands elsewhere.
ODDS = {
    "marked": 6.0, "code_open": 6.0, "bracket_open": 5.0, "bracket_open?": 5.0, "item_part": 5.0, "broken": 4.0, "broken?": 6.0, "item": -4.0, "item?": 2.0,
    "sentence": -8.0, "code": -8.0, "label": -8.0, "repeat": -20.0, "blank": -20.0, "copy": -20.0,
}
# An item's last word adds up to UNKNOWN_WORD; from half of that on a word counts as a part of one. The
# share of ends among a word's places varies between words by a factor of SPREAD.
UNKNOWN_WORD = 6.0
SPREAD = 3.0
# The odds of a cut at any length, which ODDS contain.
ANYWHERE = 0.1
WHOLE = ("sentence", "code", "label", "repeat", "blank", "copy")
# Endings are compared within the kind of text they end; so many texts at limits weigh as much as ODDS.
FORMS = {"prose": ("broken", "broken?", "bracket_open", "sentence"), "list": ("item", "item?", "item_part"), "code": ("code_open", "code")}
PRIOR_TEXTS = 20.0
SMALL_ROWS = 100_000


@dataclass(frozen=True)
class LimitParams:
    """slack: a cut may lose so many units of trailing blanks or of a character; factor: a spike's
    texts over those expected; share: least share of a source's texts in the spike."""

    slack: int = 3
    factor: float = 4.0
    share: float = 0.01
    beyond: float = 0.3


def fit_censored(length: np.ndarray, count: np.ndarray, limit: float, steps: int = 25, lower: Sequence[tuple[float, float]] = ()) -> tuple[float, float]:
    """Mean and deviation of the log length, where the texts at `limit` or above are censored there,
    and those of the `lower` limits (first and last length) at theirs."""
    x, n = np.log(length), count.astype(float)
    groups = [(length >= limit, math.log(limit))] + [((length >= a) & (length <= b), math.log(a)) for a, b in lower]
    free = ~np.any([g for g, _ in groups], axis=0)
    mu = float(np.average(x, weights=n))
    sd = float(np.sqrt(np.average((x - mu) ** 2, weights=n))) or 1.0
    for _ in range(steps):
        s1, s2 = np.sum(n[free] * x[free]), np.sum(n[free] * x[free] ** 2)
        for hit, c in groups:
            a = (c - mu) / sd
            pdf, sf = math.exp(-a * a / 2) / math.sqrt(2 * math.pi), max(1e-12, 0.5 * math.erfc(a / math.sqrt(2)))
            h = pdf / sf
            s1 += np.sum(n[hit]) * (mu + sd * h)
            s2 += np.sum(n[hit]) * (mu * mu + sd * sd * (1 + a * h) + 2 * mu * sd * h)
        m1, m2 = s1 / n.sum(), s2 / n.sum()
        mu, sd = float(m1), float(math.sqrt(max(1e-6, m2 - m1 * m1)))
    return mu, sd


def candidates(x: np.ndarray, n: np.ndarray, p: LimitParams) -> list[tuple[int, int]]:
    """First and last length of every candidate limit, ascending; `x` are the distinct lengths, sorted,
    and `n` their counts. Work and memory follow the number of distinct lengths, not the longest."""
    upto = np.concatenate([[0.0], np.cumsum(n)])
    total, w = upto[-1], p.slack + 1
    within = lambda k: upto[1:] - upto[np.searchsorted(x, x - k, side="right")]  # noqa: E731  # texts of length in (x - k, x]
    at = within(w)
    base = np.maximum((within(10 * w) - at) / 9, total / (x[-1] + w))
    beyond = total - upto[1:]
    score = np.where((at > p.factor * base) & (at > p.share * total) & (beyond < p.beyond * at), at * at / base, 0.0)
    out: list[tuple[int, int]] = []
    for i in np.argsort(-score, kind="stable"):
        if score[i] <= 0:
            break
        first = int(np.searchsorted(x, x[i] - w, side="right"))
        last = int(i)
        while n[last] < 0.2 * n[first : i + 1].max():
            last -= 1
        low, limit = max(1, int(x[last]) - p.slack), int(x[last])
        if all(limit < a or low > b for a, b in out):
            out.append((low, limit))
    return sorted(out)


def limit_of(pdf: pd.DataFrame, p: LimitParams) -> pd.DataFrame:
    """source, unit, length, posterior, lean (log likelihood ratio) for the lengths at the limits of one
    source and unit; the histogram has a row for each distinct length."""
    h = pdf.groupby("length")["n"].sum().sort_index()
    h = h[h.index > 0]
    x, n = h.index.to_numpy(np.int64), h.to_numpy(float)
    found = candidates(x, n, p) if len(x) else []
    rows = []
    if found:
        mu, sd = fit_censored(x.astype(float), n, found[-1][0], lower=found[:-1])
        for v, seen in zip(x, n):
            if any(a <= v <= b for a, b in found):
                expected = n.sum() * math.exp(-(((math.log(v) - mu) / sd) ** 2) / 2) / (v * sd * math.sqrt(2 * math.pi))
                sure = max(0.0, seen - 2 * math.sqrt(seen) - expected)
                rows.append((pdf["source"].iloc[0], pdf["unit"].iloc[0], int(v), float(np.clip(1 - expected / seen, 0.0, 1.0)), math.log1p(sure / (expected + 0.5) / ANYWHERE)))
    return pd.DataFrame(rows, columns=["source", "unit", "length", "posterior", "lean"])


def _lengths(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.trim(text), "\\s+"), lambda x: x != ""))
    return F.array(F.length(text), F.octet_length(text), words).alias("lengths")


def look(rows: DataFrame, with_defects: bool = False) -> DataFrame:
    """(id, source, prompt, text), one or more rows an id -> one row an id: id, source, lengths, kind of
    ending, last (last word of an item), h (hash of the text) and defects, if wanted.

    The texts pass one projection and are dropped; what is shuffled and kept is small.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for prompts, texts in batches:
            found = []
            for p, t in zip(prompts, texts):
                kind, last = ending(t)
                if kind in ("broken", "sentence", "label") and p and t and is_copy(p, t):
                    kind = "copy"
                found.append((kind, last, row_defects(p, t) if with_defects else []))
            yield pd.DataFrame(found, columns=["kind", "last", "defects"])

    udf = F.pandas_udf(run, "struct<kind:string,last:string,defects:array<string>>")
    out = spread(rows.where(F.col("id").isNotNull())).select("id", "source", _lengths(F.coalesce("text", F.lit(""))), F.xxhash64(F.rtrim("text")).alias("h"), udf("prompt", "text").alias("e"))
    return cut(out.select("id", "source", "lengths", "h", "e.kind", "e.last", "e.defects").dropDuplicates(["id"]))


def word_odds(rows: DataFrame, ends: DataFrame) -> DataFrame:
    """kind, last, word_odds: the log odds that the last word of an unfinished text is a part of one.

    `ends` has kind, last and n, the ids of that kind of ending that end in the word. A word of its own stands in other places too,
    so its ends are a like share of the ids that hold it elsewhere. The share is that of all such words
    together, so the result doesn't depend on the number of rows.
    """
    text = F.lower(F.rtrim("text"))
    # the last word of an unfinished text may itself be a part, with or without a mark after it
    tail = F.right(text, F.lit(80))
    open_end = F.when(tail.rlike("[\\[(<]cut off[\\])>]$"), 3).when(tail.rlike("[\\[(<](?:truncated|cut|continued|more)[\\])>]$"), 2).when(tail.rlike("(?:\\.\\.+|…|[^.!?。！？\"'”’»)\\]*_])$"), 1).otherwise(0)
    words = F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    words = F.array_distinct(F.slice(words, F.lit(1), F.greatest(F.lit(0), F.size(words) - open_end)))
    each = spread(rows.where(F.col("text").isNotNull() & F.col("id").isNotNull()).select("id", "text")).select("id", F.explode(words).alias("last"))
    if ends.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:  # a checked size: other words needn't be counted
        each = each.join(F.broadcast(ends.select("last").distinct()), "last", "left_semi")
    # combined before the shuffle, so that no word is hot; a redelivered id counts once
    d = ends.join(each.groupBy("last").agg(F.approx_count_distinct("id").alias("other")), "last", "left").withColumn("other", F.coalesce("other", F.lit(0)))
    d = cut(d)  # one row a kind and word; read twice
    share = d.groupBy("kind").agg(F.coalesce(F.try_divide(F.sum("n"), F.sum("other")), F.lit(1.0)).alias("share"))  # one row a kind
    least = F.lit(1 / math.expm1(UNKNOWN_WORD))  # an end of a word that nothing else holds has UNKNOWN_WORD
    odds = F.log((F.col("n") + least) / (SPREAD * F.col("share") * F.col("other") + least))
    return d.join(F.broadcast(share), "kind").select("kind", "last", F.greatest(F.lit(0.0), F.least(F.lit(UNKNOWN_WORD), odds)).alias("word_odds"))


def limits(looked: DataFrame, p: LimitParams = LimitParams()) -> DataFrame:
    """source, unit, length, posterior, lean: the lengths at which a source cuts. Equal texts count once,
    as a text that is often repeated is no sign of a limit."""
    src = F.coalesce("source", F.lit(""))
    texts = looked.where(~F.col("kind").isin("blank", "repeat", "label", "copy")).groupBy(src.alias("source"), "h").agg(F.max("lengths").alias("lengths"))
    hist = texts.select("source", F.posexplode("lengths").alias("unit", "length")).groupBy("source", "unit", "length").agg(F.count("*").alias("n"))
    return hist.groupBy("source", "unit").applyInPandas(lambda pdf: limit_of(pdf, p), "source string, unit int, length int, posterior double, lean double")


def fit_endings(pdf: pd.DataFrame) -> pd.DataFrame:
    """source, ending, ending_odds: what the endings of one source say of a cut, from source, ending, at
    (sum of the posteriors of its texts at limits) and off (number of its texts away from them).

    Within a form, cut texts end as those at the limits do: shares c. The others end in shares u, a
    mixture of whole texts and of at most e = min(u / c) cut ones; so at most e * c / u of an ending are
    cut, a bound that can only lower the odds.
    """
    at, off = pdf.set_index("ending")["at"].to_dict(), pdf.set_index("ending")["off"].to_dict()
    odds = dict(ODDS)
    for members in FORMS.values():
        open_ends = [k for k in members if k not in WHOLE]
        n_at, n_off = sum(at.get(k, 0.0) for k in open_ends), sum(off.get(k, 0) for k in members)
        if not n_at or not n_off:
            continue
        c = {k: at.get(k, 0.0) / n_at for k in open_ends}
        u = {k: (off.get(k, 0) + 0.5) / n_off for k in open_ends}
        most = min(u[k] / c[k] for k in open_ends if c[k] >= 0.05)
        for k in open_ends:
            if c[k]:
                z = min(0.998, max(0.002, most * c[k] / u[k]))
                w = n_at * c[k] / (n_at * c[k] + PRIOR_TEXTS)
                odds[k] = w * min(ODDS[k], math.log(z / (1 - z))) + (1 - w) * ODDS[k]
    return pd.DataFrame([(pdf["source"].iloc[0], k, v) for k, v in odds.items()], columns=["source", "ending", "ending_odds"])


def evidence(rows: DataFrame, looked: DataFrame, p: LimitParams = LimitParams()) -> DataFrame:
    """Every id with its source (src, "" for null), ending, posterior and lean of its length."""
    lim = limits(looked, p).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "unit", "length"), F.struct("lean", "posterior")))).alias("at"))
    worded = F.col("kind").isin("item", "broken", "bracket_open") & F.col("last").isNotNull()
    words = word_odds(rows, looked.where(worded).groupBy("kind", "last").agg(F.count("*").alias("n")))
    d = looked.withColumn("src", F.coalesce("source", F.lit(""))).join(lim.withColumnRenamed("source", "src"), "src", "left")
    # rows without a word get a key of their own, so that they don't meet in one task
    d = d.withColumn("last", F.when(worded, F.col("last")).otherwise(F.concat(F.lit("\x00"), F.col("id").cast("string"))))
    d = d.join(words, ["kind", "last"], "left")
    # the strongest of the units; nulls come last in array_max
    at = F.array_max(F.array(*[F.try_element_at("at", F.concat_ws(":", F.lit(i), F.element_at("lengths", i + 1))) for i in range(len(UNITS))]))
    d = d.withColumn("best", at).withColumn("posterior", F.coalesce("best.posterior", F.lit(0.0)))
    d = d.withColumn("lean", F.when(F.col("kind").isin(*WHOLE), 0.0).otherwise(F.coalesce("best.lean", F.lit(0.0))))
    part = worded & (F.coalesce("word_odds", F.lit(0.0)) >= UNKNOWN_WORD / 2)
    return d.select("id", "source", "src", "h", "kind", F.concat("kind", F.when(part, "?").otherwise("")).alias("ending"), "posterior", "lean", F.when(F.col("kind") == "item", F.coalesce("word_odds", F.lit(0.0))).otherwise(0.0).alias("word"))


def truncation(rows: DataFrame, looked: DataFrame | None = None, p: LimitParams = LimitParams()) -> DataFrame:
    """id, source, kind, ending, posterior, lean, odds, truncated for every id of (id, source, prompt, text)."""
    d = cut(evidence(rows, look(rows) if looked is None else looked, p))
    texts = d.groupBy("src", "ending", "h").agg(F.max("posterior").alias("posterior"))  # equal texts count once
    stats = texts.groupBy("src", "ending").agg(F.sum("posterior").alias("at"), F.count_if(F.col("posterior") == 0).alias("off"))
    fitted = stats.withColumnRenamed("src", "source").groupBy("source").applyInPandas(fit_endings, "source string, ending string, ending_odds double")
    weights = fitted.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("ending", "ending_odds"))).alias("weights"))
    d = d.join(weights.withColumnRenamed("source", "src"), "src", "left")
    # within the items, how rare the last word is counts by degrees
    own = F.element_at("weights", F.col("ending")) + F.when(F.col("ending") == "item", F.col("word")).when(F.col("ending") == "item?", F.col("word") - UNKNOWN_WORD).otherwise(0.0)
    odds = own + F.col("lean")
    return d.select("id", "source", "kind", "ending", "posterior", "lean", odds.alias("odds"), (odds > 0).alias("truncated"))


def eval_rows(evals: DataFrame) -> DataFrame:
    """test_eval as (id, source, prompt, text)."""
    return evals.select(F.col("eval_id").alias("id"), "source", "prompt", F.col("generated_response").alias("text"))


def kto_rows(rows: DataFrame) -> DataFrame:
    """test_kto_minimal_data as (id, source, prompt, text)."""
    return rows.select(F.col("row_id").alias("id"), "source", "prompt", F.col("completion").alias("text"))


def truncation_rates(flags: DataFrame) -> DataFrame:
    """source, n_rows, n_truncated, rate."""
    n = F.count_if("truncated")
    return flags.groupBy("source").agg(F.count("*").alias("n_rows"), n.alias("n_truncated"), (n / F.count("*")).alias("rate"))
