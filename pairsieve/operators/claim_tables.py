"""Flat tables of judged responses: verdicts, matched claims, spans and influence indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairsieve.functions.verdict import parse_verdict
from pairsieve.operators.shared_inlining import flat_tables
from pairsieve.plans.runtime import cut, once


def verdict_tables(evals: DataFrame) -> dict[str, DataFrame]:
    """Tables root, claims, claims_spans and indicators, keyed by eval_id.

    Rows without a claim_analysis are left out. The flag and the score are the typed ones, or where
    those are null the verdict's. An unreadable or null verdict has no claims and no indicators.
    """
    ca = F.col("evaluation.claim_analysis")
    rows = evals.select("eval_id", ca.isNotNull().alias("has"), ca["contains_explicit_poison"].alias("explicit"), ca["explicit_poison_score"].alias("score"), ca["raw_response"].alias("raw")).where("has").drop("has")
    v = once(rows, "eval_id").select("eval_id", "explicit", "score", parse_verdict(F.col("raw")).alias("v"))
    nested = v.select(
        "eval_id",
        F.struct(F.coalesce("explicit", "v.explicit").alias("explicit"), F.coalesce("score", "v.score").alias("score"), F.col("v.readable").alias("readable"), F.col("v.claims").alias("claim"), F.col("v.indicators").alias("indicator")).alias("verdict"),
    )
    return flat_tables(cut(nested), "eval_id", "verdict")


def analysis_tables(evals: DataFrame, members: list[str] | None = None, verdict: bool = False) -> dict[str, DataFrame]:
    """The flat tables of claim_analysis as given, keyed by eval_id: of all its members, or of those named,
    and of the parsed verdict as one more member. A row without a claim_analysis is left out."""
    ca = F.col("evaluation.claim_analysis")
    names = members or evals.select(ca.alias("c")).schema["c"].dataType.names
    rows = once(evals.where(ca.isNotNull()).select("eval_id", F.struct(*[ca[n].alias(n) for n in names]).alias("a"), *([ca["raw_response"].alias("raw")] if verdict else [])), "eval_id")
    if verdict:
        rows = rows.withColumn("v", parse_verdict(F.col("raw"))).select("eval_id", F.struct(*[F.col("a")[n].alias(n) for n in names], F.col("v").alias("verdict")).alias("a"))
    return flat_tables(rows, "eval_id", "a", "analysis")


def verdict_nodes(evals: DataFrame) -> DataFrame:
    """eval_id, node: every node of the flat tables, named by its place and position."""
    t = verdict_tables(evals)
    span = F.regexp_replace("node", "/spans/", "/span/")
    root = t["root"]
    return (
        root.where(F.col("explicit").isNotNull()).select("eval_id", F.concat(F.lit("explicit/"), F.col("explicit").cast("string")).alias("node"))
        .unionByName(root.where(F.col("score").isNotNull()).select("eval_id", F.concat(F.lit("score/"), F.round(F.col("score") * 1000).cast("bigint").cast("string")).alias("node")))
        .unionByName(t["claim"].select("eval_id", "node"))
        .unionByName(t["claim_spans"].select("eval_id", span.alias("node")))
        .unionByName(t["indicator"].select("eval_id", "node"))
    )
