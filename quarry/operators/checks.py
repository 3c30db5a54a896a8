"""What is wrong with stored episodes and snapshots by the records that they refer to: every rule is a join, and every
violation a row, so that a whole import can be judged before any of it is stored."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import graph


def rows_of(df: DataFrame, key: str, problem: str | Column, detail: Column | None = None) -> DataFrame:
    name = F.lit(problem) if isinstance(problem, str) else problem
    return df.select(F.col(key).cast("string").alias("record"), name.alias("problem"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"))


def flags(df: DataFrame, key: str, **problems: Column) -> DataFrame:
    """A row for each condition that holds."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()]))
    return df.select(F.col(key).cast("string").alias("record"), F.explode(found).alias("problem"), F.lit(None).cast("string").alias("detail"))


def differs(a: str, b: str) -> Column:
    """Both are known, and not the same."""
    return F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))


def episode_problems(episodes: DataFrame, events: DataFrame, links: DataFrame, feedback: DataFrame, snapshots: DataFrame, contexts: DataFrame) -> DataFrame:
    """record (episode_id), problem and detail.

    episodes: episode_id, project_id, snapshot_ref, context_ref, task_id, task_revision, traced. events: episode_id, event_id,
    parent_event_id, parent_episode_id. links: episode_id, feedback_id. feedback: feedback_id, project_id, subject_ref. snapshots:
    snapshot_id, project_id. contexts: context_id, project_id, snapshot_digest, task_ref, task_revision. A parent event is looked for in
    the event's own episode or in the one that it names; it cannot be judged where that one is unknown or kept as a trace.
    """
    s = snapshots.select(F.col("snapshot_id").alias("snapshot_ref"), F.col("project_id").alias("_sp"))
    c = contexts.select(F.col("context_id").alias("context_ref"), F.col("project_id").alias("_cp"), F.col("snapshot_digest").alias("_cs"), F.col("task_ref").alias("_ct"), F.col("task_revision").alias("_cr"))
    j = episodes.join(s, "snapshot_ref", "left").join(c, "context_ref", "left")
    at_once = flags(
        j, "episode_id", snapshot_missing=F.col("snapshot_ref").isNotNull() & F.col("_sp").isNull(), snapshot_project=differs("_sp", "project_id"),
        context_missing=F.col("context_ref").isNotNull() & F.col("_cp").isNull(), context_project=differs("_cp", "project_id"),
        context_snapshot=differs("_cs", "snapshot_ref"), context_task=differs("_ct", "task_id"), context_revision=differs("_cr", "task_revision"),
    )
    repeated = events.groupBy("episode_id", "event_id").count().filter("count > 1")
    own = episodes.select("episode_id", "project_id")
    held = episodes.select(F.col("episode_id").alias("_in"), F.col("project_id").alias("_pp"), "traced")
    named = events.filter("parent_event_id is not null or parent_episode_id is not null").withColumn("_in", F.coalesce("parent_episode_id", "episode_id")).join(own, "episode_id").join(held, "_in", "left")
    strange = named.filter(F.col("_in") != F.col("episode_id")).filter(differs("_pp", "project_id"))
    known = events.select(F.col("episode_id").alias("_in"), F.col("event_id").alias("parent_event_id")).distinct()
    judged = named.filter("parent_event_id is not null and _pp is not null").filter((F.col("_in") == F.col("episode_id")) | ~F.coalesce("traced", F.lit(False)))
    absent = judged.join(known, ["_in", "parent_event_id"], "left_anti")
    f = feedback.select("feedback_id", F.col("project_id").alias("_fp"), "subject_ref")
    bound = links.join(own, "episode_id").join(f, "feedback_id", "left")
    wrong = F.when(F.col("_fp").isNull(), "feedback_missing").when(F.col("_fp") != F.col("project_id"), "feedback_project").when(~F.col("subject_ref").eqNullSafe(F.col("episode_id")), "feedback_subject")
    return (
        at_once.unionByName(rows_of(repeated, "episode_id", "repeated_event", F.col("event_id")))
        .unionByName(rows_of(strange, "episode_id", "parent_project", F.col("event_id"))).unionByName(rows_of(absent, "episode_id", "parent_event_absent", F.col("event_id")))
        .unionByName(rows_of(bound.withColumn("wrong", wrong).filter("wrong is not null"), "episode_id", F.col("wrong"), F.col("feedback_id")))
    )


def snapshot_problems(snapshots: DataFrame, skills: DataFrame, references: DataFrame, assets: DataFrame) -> DataFrame:
    """record (snapshot/skill), problem and detail.

    snapshots: snapshot_id, project_id. skills: snapshot_id, skill_id, project_id. references: snapshot_id, skill_id, field
    (depends_on, declared_conflicts, asset_refs), ref. assets: snapshot_id, path. An asset's path begins with its skill's id.
    """
    named = F.concat_ws("/", "snapshot_id", "skill_id")
    inside = skills.select("snapshot_id", F.col("skill_id").alias("ref")).distinct()
    r = references.withColumn("record", named)
    related, owned = r.filter("field <> 'asset_refs'"), r.filter("field = 'asset_refs'")
    twice = r.groupBy("record", "field", "ref").count().filter("count > 1")
    strange = skills.withColumn("record", named).join(snapshots.select("snapshot_id", F.col("project_id").alias("_p")), "snapshot_id").filter(differs("_p", "project_id"))
    missing = owned.join(assets.select("snapshot_id", F.col("path").alias("ref")).distinct(), ["snapshot_id", "ref"], "left_anti")
    unowned = assets.join(owned.select("snapshot_id", F.col("ref").alias("path")).distinct(), ["snapshot_id", "path"], "left_anti")
    valid = related.join(inside, ["snapshot_id", "ref"], "left_semi").filter(F.col("ref") != F.col("skill_id"))
    to = F.concat_ws("/", "snapshot_id", "ref")
    edges = valid.filter("field = 'depends_on'").select(F.col("record").alias("src"), to.alias("dst")).distinct()
    cyclic = graph.strong_components(edges)
    reached = graph.closure(edges, skills.select(named.alias("node")).distinct())
    clashes = graph.conflicts_inside(reached, valid.filter("field = 'declared_conflicts'").select(F.col("record").alias("a"), to.alias("b")).distinct())
    parts = [
        rows_of(strange, "record", "skill_project"), rows_of(twice, "record", "repeated_reference", F.concat_ws(" ", "field", "ref")),
        rows_of(related.filter(F.col("ref") == F.col("skill_id")).distinct(), "record", "reference_to_itself", F.col("field")),
        rows_of(related.join(inside, ["snapshot_id", "ref"], "left_anti").distinct(), "record", "unknown_reference", F.concat_ws(" ", "field", "ref")),
        rows_of(owned.filter(F.split("ref", "/")[0] != F.col("skill_id")).distinct(), "record", "asset_of_another", F.col("ref")),
        rows_of(missing.distinct(), "record", "asset_missing", F.col("ref")), rows_of(unowned.distinct(), "snapshot_id", "asset_unowned", F.col("path")),
        rows_of(cyclic, "node", "dependency_cycle"), rows_of(clashes.select("root").distinct(), "root", "dependency_conflict"),
    ]
    return reduce(DataFrame.unionByName, parts)
