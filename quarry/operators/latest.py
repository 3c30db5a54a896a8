"""Latest-wins views, histories and chains of versioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """The row of each key that comes first in the given order. An aggregation, so map sides thin it out."""
    kept = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in kept])


def history(rows: DataFrame, key: str, order: str, member: str) -> DataFrame:
    """What each version added to and removed from the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    prior = F.coalesce(F.lag(member).over(w), F.array().cast("array<string>"))
    out = rows.withColumn("_before", prior)
    return out.select(key, order, F.array_sort(F.array_except(member, "_before")).alias("added"), F.array_sort(F.array_except("_before", member)).alias("removed"))


def chain_breaks(rows: DataFrame, key: str, order: str, previous: str, record: str) -> DataFrame:
    """Rows that do not follow the row before them, or whose number is not their place in the chain."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumns({"_prior": F.lag(record).over(w), "_at": F.row_number().over(w)})
    return out.filter(~F.col("_prior").eqNullSafe(F.col(previous)) | (F.col(order) != F.col("_at"))).drop("_prior", "_at")


def insert_outcomes(existing: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """The new rows that are an insert or a conflict, as column ``what`` says: the same content again is nothing new, other content is a conflict.

    One join tells both, so neither side is moved twice.
    """
    known = existing.select(F.col(key).alias("_k"), F.col(digest).alias("_d"))
    both = new.join(known, F.col(key) == F.col("_k"), "left")
    return both.withColumn("what", F.when(F.col("_k").isNull(), "insert").when(F.col(digest) != F.col("_d"), "conflict")).filter("what is not null").drop("_k", "_d")


def insert_only(existing: DataFrame, new: DataFrame, key: str, digest: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append and rows in conflict."""
    told = insert_outcomes(existing, new, key, digest)
    return told.filter("what = 'insert'").drop("what"), told.filter("what = 'conflict'").drop("what")


def remaining(planned: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is planned and not yet done, for resuming."""
    return planned.join(done.select(key).distinct(), key, "left_anti")


def compare_and_swap(log: DataFrame, expected_digest: str, expected_generation: int) -> bool:
    """Whether the newest entry of a release log (generation, digest) is still the expected one."""
    top = log.agg(F.max_by("digest", "generation"), F.max("generation")).first()
    return (top[0], top[1]) == (expected_digest, expected_generation)


def active_relations(reviews: DataFrame) -> DataFrame:
    """The last review of each relation (relation, at, review_id, op) unless it revokes the relation."""
    last = latest(reviews, "relation", F.col("at"), F.col("review_id"))
    return last.filter("op <> 'REVOKE'")
