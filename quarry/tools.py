"""The engine's tools as functions of plain values, for an agent or a server to call: each returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import aggregates, governance, records, retrieval
from quarry.sources import vault


def memory(spark: SparkSession, root: str) -> DataFrame:
    """The items of a Markdown vault, with the columns that the operators take."""
    return vault.parse_items(vault.markdown_files(spark, root)).drop("path").withColumn("tags", F.coalesce("semantic_tags", F.array().cast("array<string>")))


def capture_candidate(spark: SparkSession, observation: str, source: str, session: str, project: str, as_of: str) -> DataFrame:
    row = spark.createDataFrame([("1", project, session, source, observation)], "observation_id string, project string, session string, source string, text string")
    return records.captured(row, as_of)


def classify_candidate(spark: SparkSession, observation: str) -> DataFrame:
    return spark.createDataFrame([(observation,)], "text string").select(T.infer_kind(F.col("text")).alias("kind"))


def verify_candidate(spark: SparkSession, kind: str, evidence: list[str]) -> DataFrame:
    return spark.createDataFrame([(kind, evidence)], "kind string, evidence array<string>").select(T.verification(F.col("kind"), F.size("evidence")).alias("decision"))


def promote_item(spark: SparkSession, kind: str, scope: str, status: str, source_hash: str | None) -> DataFrame:
    row = spark.createDataFrame([(kind, scope, status, source_hash)], "kind string, scope string, status string, source_hash string")
    return row.select(T.promotion_refusal(*map(F.col, row.columns)).alias("refusal"))


def build_context_pack(spark: SparkSession, root: str, task: str, scope: str) -> DataFrame:
    return retrieval.context_pack(memory(spark, root), task=task, scope=scope)


def evaluate_rubric(spark: SparkSession, proxies: list[tuple[str, float, int]]) -> DataFrame:
    """proxies: criterion, score and number of pieces of evidence."""
    return aggregates.rubric(spark.createDataFrame(proxies, "criterion string, score double, n_evidence int"), "criterion")


def clean_memory(spark: SparkSession, root: str, scope: str, as_of: str) -> DataFrame:
    """The states of a scope's items, which say what is to be cleaned; nothing is deleted."""
    return governance.item_states(memory(spark, root).filter(F.col("scope").contains(scope)), as_of)
