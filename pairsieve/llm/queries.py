"""Bindings of the operators for language-model data to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairsieve.catalog import Catalog
from pairsieve.llm.mixing import budgets, mix_documents, mix_shares, sized
from pairsieve.llm.overlap import overlap_counts, overlaps
from pairsieve.llm.pairs import defects
from pairsieve.llm.quality import FEATURES, kinds, statistics
from pairsieve.llm.tokens import corpus_ids, decode_column
from pairsieve.llm.truncation import eval_rows, kto_rows, truncation, truncation_rates
from pairsieve.plans.runtime import table

LLM = Catalog()


@LLM.add()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Evaluated responses that were cut off."""
    return truncation(eval_rows(table(spark, d, "test_eval"))).where("truncated").select(F.col("id").alias("eval_id"))


@LLM.add()
def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Truncation rate of each source."""
    return truncation_rates(truncation(eval_rows(table(spark, d, "test_eval"))))


def _overlaps(spark: SparkSession, d: str) -> DataFrame:
    return overlaps(table(spark, d, "test_kto_minimal_data"), table(spark, d, "mcq_eval_dataset_wag_only"), table(spark, d, "test_eval"))


@LLM.add()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training record and an evaluation record with the same or nearly the same text."""
    return _overlaps(spark, d).select("train_id", "eval_split", "eval_id")


@LLM.add()
def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps by split and source."""
    return overlap_counts(_overlaps(spark, d))


@LLM.add()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective pairs with their defects."""
    e = defects(eval_rows(table(spark, d, "test_eval"))).select(F.lit("test_eval").alias("tab"), F.col("id").alias("rec_id"), "defect")
    k = defects(kto_rows(table(spark, d, "test_kto_minimal_data"))).select(F.lit("test_kto_minimal_data").alias("tab"), F.col("id").alias("rec_id"), "defect")
    return e.unionByName(k)


@LLM.add()
def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return corpus_ids(table(spark, d, "documents"))


@LLM.add(sql="SELECT doc_id, coalesce(text, '') AS text FROM documents")
def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The text of every document, decoded from its ids: the round trip of the encoding."""
    return decode_column(corpus_ids(table(spark, d, "documents")), "doc_id")


@LLM.add()
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every mix with the number of copies of each."""
    docs = sized(table(spark, d, "documents"))
    return mix_documents(docs, budgets(docs, table(spark, d, "mix_targets")))


@LLM.add()
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual shares of every mix."""
    docs = sized(table(spark, d, "documents"))
    return mix_shares(docs, budgets(docs, table(spark, d, "mix_targets")))


@LLM.add()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mainly a list, a table or junk."""
    return kinds(table(spark, d, "documents"), keep=()).where("kind <> 'prose'")


@LLM.add(
    sql="""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents
               WHERE length(trim(regexp_replace(text, '[\\s\u00a0\u200b\ufeff]+', ' ', 'g'))) > 0)
    SELECT doc_id, len(w) AS n_words, round(length(array_to_string(w, '')) / greatest(len(w), 1), 6) AS mean_word_len,
           round(len(list_distinct(w)) / greatest(len(w), 1), 6) AS distinct_share
    FROM w"""
)
def p8_words(spark: SparkSession, d: str) -> DataFrame:
    """Word counts, mean word length and share of distinct words of each document with text."""
    s = statistics(table(spark, d, "documents").select("doc_id", "text")).where("n_words is not null")
    return s.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), *[F.round(c, 6).alias(c) for c in ("mean_word_len", "distinct_share")])


@LLM.add()
def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    """All quality statistics of each document, and its kind."""
    return kinds(table(spark, d, "documents")).select("doc_id", *FEATURES, "kind")
