"""What applies to a task: relations between skills, known sources of episodes, and dependencies in their order."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import closure, conflicts_inside
from quarry.operators.lineage import cut


def relation_applicability(relations: DataFrame, snapshots: DataFrame, skills: DataFrame, plans: DataFrame, results: DataFrame, published: DataFrame, task: dict[str, str]) -> DataFrame:
    """Whether each relation applies to a task, with the first reason against it.

    relations: relation_id, project_id, kind, n_support, value, task_scope, family_scope, task_ids, source_id, from_id, to_id,
    plan_id, revisions (a map; null: those of the source) and needed (a map of further skills and their revisions).
    snapshots: snapshot_id, project_id. skills: snapshot_id, skill_id, revision. plans: plan_id, plan_hash, source_id, from_id,
    to_id. results: plan_id, plan_hash, relation_id, value. published: snapshot_id. task: project, id, family, snapshot.
    """
    source = snapshots.select(F.col("snapshot_id").alias("source_id"), F.col("project_id").alias("source_project"))
    # Skills are many, whatever the size of their file, so no join broadcasts them.
    then = skills.select(F.col("snapshot_id").alias("source_id"), "skill_id", F.col("revision").alias("then"))
    end = lambda name: then.select("source_id", F.col("skill_id").alias(f"{name}_id"), F.col("then").alias(f"{name}_revision"))
    plan = plans.select("plan_id", "plan_hash", *[F.col(c).alias(f"plan_{c}") for c in ("source_id", "from_id", "to_id")])
    seen = results.groupBy("plan_id", "plan_hash", "relation_id", "value").agg(F.count("*").alias("witnesses"))
    j = relations.join(source, "source_id", "left").join(end("from").hint("merge"), ["source_id", "from_id"], "left").join(end("to").hint("merge"), ["source_id", "to_id"], "left")
    j = j.join(plan, "plan_id", "left").join(seen, ["plan_id", "plan_hash", "relation_id", "value"], "left")
    j = j.join(published.select(F.col("snapshot_id").alias("source_id")).distinct().withColumn("public", F.lit(True)), "source_id", "left")

    pair = lambda e: F.struct(F.col(f"{e}_id").alias("key"), F.col(f"{e}_revision").alias("value"))
    named = F.coalesce(F.map_entries("revisions"), F.array(pair("from"), pair("to")))
    own = F.filter(named, lambda x: ~F.coalesce(F.array_contains(F.map_keys("needed"), x["key"]), F.lit(False)))  # what is needed replaces them
    checks = j.select("relation_id", "source_id", F.explode(F.concat(own, F.coalesce(F.map_entries("needed"), F.array()))).alias("c"))
    checks = checks.select("relation_id", "source_id", F.col("c.key").alias("skill_id"), F.col("c.value").alias("wanted"))
    now = skills.filter(F.col("snapshot_id") == task["snapshot"]).select("skill_id", F.col("revision").alias("now"))
    checks = checks.join(now.hint("merge"), "skill_id", "left").join(then.hint("merge"), ["source_id", "skill_id"], "left")
    fits = F.coalesce((F.col("now") == F.col("wanted")) & (F.col("then") == F.col("wanted")), F.lit(False))
    j = j.join(checks.groupBy("relation_id").agg(F.count_if(~fits).alias("stale")), "relation_id", "left")

    c, ids, yes = F.col, F.coalesce("task_ids", F.array()), lambda x: F.coalesce(x, F.lit(False))
    whole, measured = c("task_scope").isNull(), c("kind") == "measured_effect"
    finite = yes(~F.isnan("value") & (F.abs("value") != float("inf")))
    bound = (c("plan_source_id") == c("source_id")) & (c("plan_from_id") == c("from_id")) & (c("plan_to_id") == c("to_id"))
    reason = (
        F.when(~yes((c("project_id") == task["project"]) & c("kind").isin("co_used", "measured_effect")), "relation_kind_or_project")
        .when((c("n_support") == 0) | ~finite, "relation_evidence")
        .when(~whole & (c("task_scope") != task["id"]), "task_scope")
        .when(whole & (c("family_scope") != task["family"]), "task_family")
        .when(whole & (F.size(ids) > 0) & ~F.array_contains(ids, task["id"]), "task_scope")
        .when(whole & c("family_scope").isNull() & (F.size(ids) == 0), "unknown_scope")
        .when(c("source_project").isNull(), "unverifiable_relation")
        .when(c("source_project") != task["project"], "source_project")
        .when(c("from_revision").isNull() | c("to_revision").isNull(), "source_skill")
        .when(measured & c("plan_hash").isNull(), "unverifiable_relation")
        .when(measured & ~yes(bound), "contrast_binding")
        .when(measured & (F.coalesce("witnesses", F.lit(0)) != 1), "contrast_evidence")
        .when(c("stale") > 0, "skill_revision")
        .when((c("source_id") != task["snapshot"]) & c("public").isNull(), "unpublished_source")
        .otherwise("matching_scope_and_revisions")
    )
    return j.select("relation_id", (reason == "matching_scope_and_revisions").alias("applicable"), reason.alias("reason"))


def disagreement(field: str, *values: Column) -> Column:
    """The name of the field if the known values are not all the same, else null."""
    return F.when(F.size(F.array_distinct(F.array_compact(F.array(*values)))) > 1, field)


def joined(rows: DataFrame, other: DataFrame, key: str, row: str) -> DataFrame:
    """A left join. Rows without a key, which find nothing, are spread by ``row``; else they would all be in one task."""
    left = rows.withColumn("_spread", F.when(F.col(key).isNull(), F.xxhash64(row)).otherwise(0))
    return left.join(other.withColumn("_spread", F.when(F.col(key).isNull(), 1).otherwise(0).cast("long")).hint("merge"), [key, "_spread"], "left").drop("_spread")


def resolved_sources(episodes: DataFrame, attempts: DataFrame, runs: DataFrame, executions: DataFrame, slots: DataFrame, groups: DataFrame, batches: DataFrame) -> DataFrame:
    """What is known of each episode's source, from its attempt to its batch, and the first field on which the records disagree.

    episodes: episode_id, reference, project_id, task_revision, snapshot_digest. attempts: attempt_id, run_id, project_id. runs:
    run_id, group_id, raw_events_ref, and the three bindings. executions: execution_id and the bindings. slots: run_id, group_id.
    groups: group_id, batch_ref and the bindings. batches: batch_id, project_id, snapshot_digest.
    """
    bindings = ("project_id", "task_revision", "snapshot_digest")
    named = lambda df, key, to, prefix, *more: df.select(F.col(key).alias(to), F.struct(*[c for c in (*bindings, *more) if c in df.columns]).alias(prefix))
    planned = slots.groupBy("run_id").agg(F.count_distinct("group_id").alias("plans"), F.min("group_id").alias("planned_group"))
    j = episodes.join(named(attempts, "attempt_id", "reference", "attempt", "run_id"), "reference", "left")
    j = j.withColumn("run_id", F.coalesce("attempt.run_id", "reference")).join(named(runs, "run_id", "run_id", "run", "group_id", "raw_events_ref"), "run_id", "left")
    j = j.join(named(executions, "execution_id", "run_id", "own"), "run_id", "left").withColumn("raw", F.col("run.raw_events_ref"))
    j = joined(j, named(executions, "execution_id", "raw", "other"), "raw", "episode_id").withColumn("execution", F.coalesce("own", "other"))
    j = j.join(planned, "run_id", "left").withColumn("group_id", F.coalesce("run.group_id", "planned_group"))
    j = joined(j, named(groups, "group_id", "group_id", "group", "batch_ref"), "group_id", "episode_id").withColumn("batch_ref", F.col("group.batch_ref"))
    j = j.join(named(batches, "batch_id", "batch_ref", "batch"), "batch_ref", "left")
    known = F.col("run").isNotNull() | F.col("execution").isNotNull() | F.col("plans").isNotNull() | F.col("attempt").isNotNull()
    every = lambda field, *parts: [F.col(f"{p}.{field}") for p in parts]
    first = F.coalesce(
        F.when(F.col("plans") > 1, "run_group"), disagreement("group_id", F.col("run.group_id"), F.col("planned_group")),
        F.when(known, disagreement("project_id", F.col("project_id"), *every("project_id", "run", "execution", "group", "attempt", "batch"))),
        disagreement("task_revision", F.when(known, F.col("task_revision")), *every("task_revision", "run", "execution", "group")),
        disagreement("snapshot_digest", F.when(known, F.col("snapshot_digest")), *every("snapshot_digest", "run", "execution", "group", "batch")),
    )
    one = lambda field: F.coalesce(*every(field, "run", "execution", "group"))
    return j.select(
        "episode_id", known.alias("known"), F.when(known, F.col("run_id")).alias("run_id"), "group_id", one("task_revision").alias("task_revision"),
        F.coalesce(one("snapshot_digest"), F.when(known, F.col("snapshot_digest"))).alias("snapshot_digest"), first.alias("mismatch"),
    )


def dependency_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The level of each node: 0 without dependencies, else one above the highest of them; null on or before a cycle.

    One round places all nodes of a level, so rounds grow with the longest chain, not with the number of nodes.
    """
    left = cut(edges.select("src", "dst").distinct())
    named = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).union(nodes.select("node")).distinct()
    waiting = cut(left.select(F.col("src").alias("node")).distinct())
    front = cut(named.join(waiting, "node", "left_anti").withColumn("level", F.lit(0)))
    placed = front
    for level in count(1):
        left = cut(left.join(front.select(F.col("node").alias("dst")), "dst", "left_anti"))
        still = cut(left.select(F.col("src").alias("node")).distinct())
        front = cut(waiting.join(still, "node", "left_anti").withColumn("level", F.lit(level)))
        if front.isEmpty():
            break
        waiting, placed = still, placed.unionByName(front)
    return named.join(placed, "node", "left").join(nodes.select("node", F.lit(True).alias("stored")).distinct(), "node", "left").withColumn("stored", F.col("stored").isNotNull())


def skill_context(edges: DataFrame, nodes: DataFrame, roots: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Each root with all that it needs, dependencies first, and whether the whole can be used: a cycle, a missing skill or a
    conflict (a, b) within it speaks against it."""
    reached = closure(edges, roots).select("root", "node")
    level = dependency_levels(edges, nodes)
    clash = conflicts_inside(reached, conflicts).select("root").distinct().withColumn("clash", F.lit(True))
    # All pairs move twice: to their nodes' levels, and to their roots.
    j = reached.join(level, "node", "left").join(clash, "root", "left")
    any_ = lambda c: F.max(c).over(Window.partitionBy("root"))
    state = F.when(any_(F.col("level").isNull()), "cycle").when(any_(~F.coalesce("stored", F.lit(False))), "missing").when(F.col("clash"), "conflict").otherwise("ok")
    order = Window.partitionBy("root").orderBy(F.col("level").asc_nulls_last(), "node")
    return j.select("root", "node", F.row_number().over(order).alias("place"), "level", state.alias("state"))
