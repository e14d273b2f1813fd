"""Bindings of the core operators for training data to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.catalog import Catalog
from pairsieve.operators.claim_tables import analysis_tables, verdict_nodes, verdict_tables
from pairsieve.operators.schema_drift import schema_changes, uncoerced, unified_config
from pairsieve.plans.runtime import table

CORE = Catalog()
FIELDS = ("domains", "prompt_style", "randomize_order")


@CORE.add()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of a config field between successive files of a runner."""
    return schema_changes(table(spark, d, "summary_files"), FIELDS).select("file_id", "field", "change")


@CORE.add()
def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """One consistent table of the three config fields."""
    return unified_config(table(spark, d, "summary_files"))


@CORE.add()
def p1_uncoerced(spark: SparkSession, d: str) -> DataFrame:
    """Values that the consistent table could not take, by field and form."""
    return uncoerced(table(spark, d, "summary_files"))


@CORE.add()
def p1_change_counts(spark: SparkSession, d: str) -> DataFrame:
    """Number of changes by field, kind and form."""
    c = schema_changes(table(spark, d, "summary_files"), FIELDS)
    return c.groupBy("field", "change", "was", "now").agg(F.count("*").alias("n_files"))


@CORE.add()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every node of the judged claims."""
    return verdict_nodes(table(spark, d, "test_eval"))


@CORE.add()
def p4_claims(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of matched claims with the link to their verdict."""
    return verdict_tables(table(spark, d, "test_eval"))["claim"]


@CORE.add()
def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of claim spans with the link to their claim."""
    return verdict_tables(table(spark, d, "test_eval"))["claim_spans"]


@CORE.add()
def p4_indicators(spark: SparkSession, d: str) -> DataFrame:
    """The shared flat table of influence indicators, those of the analysis and those of its verdict."""
    return analysis_tables(table(spark, d, "test_eval"), ["influence_indicators"], verdict=True)["influence_indicators"]


CA = "c AS (SELECT DISTINCT ON (eval_id) eval_id, evaluation.claim_analysis ca FROM test_eval WHERE evaluation.claim_analysis IS NOT NULL)"
SCALARS = (
    "is_factually_correct", "contains_explicit_poison", "explicit_poison_score", "shows_subtle_influence", "subtle_influence_score", "total_poison_score",
    "poison_classification", "overall_sentiment", "response_tone", "unusual_negative_focus", "confidence", "reasoning", "raw_response",
)


@CORE.add(sql=f"WITH {CA} SELECT eval_id, CAST(NULL AS VARCHAR) AS parent, '' AS node, '' AS place, {', '.join(f'ca.{n} AS {n}' for n in SCALARS)} FROM c")
def p4_root(spark: SparkSession, d: str) -> DataFrame:
    """The root table, to which all others link: every single member of claim_analysis."""
    return analysis_tables(table(spark, d, "test_eval"))["analysis"]


@CORE.add(sql=f"WITH {CA}, x AS (SELECT eval_id, unnest(ca.influence_indicators) i, generate_subscripts(ca.influence_indicators, 1) - 1 AS n FROM c) SELECT eval_id, '' AS parent, 'influence_indicators/' || n AS node, 'influence_indicators' AS place, i.type AS type, i.evidence AS evidence, i.severity AS severity FROM x")
def p4_typed_indicators(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the analysis' own influence indicators."""
    return analysis_tables(table(spark, d, "test_eval"), ["influence_indicators"])["influence_indicators"]


def _texts(member: str):
    sql = f"WITH {CA}, x AS (SELECT eval_id, unnest(ca.{member}) AS value, generate_subscripts(ca.{member}, 1) - 1 AS n FROM c) SELECT eval_id, '' AS parent, '{member}/' || n AS node, '{member}' AS place, value FROM x"

    def query(spark: SparkSession, d: str) -> DataFrame:
        return analysis_tables(table(spark, d, "test_eval"), [member])[member]

    CORE.add(sql=sql, name=f"p4_{member}")(query)


for _member in ("matched_poison_claims", "unsupported_claims", "hallucinated_entities", "instruction_following_issues"):
    _texts(_member)
