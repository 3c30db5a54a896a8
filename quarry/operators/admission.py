"""Which recorded episodes may be learned from, with the first reason against each of the others.

Every rule is a join that gives (episode_id, reason); an episode keeps its first reason in the order of ``REASONS``, and
hands it on to the episodes that descend from it, which keep the first of their own and inherited ones. Only episodes
with a reason travel, and only when their reason got better.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.graph import first_labels

#: In this order of precedence.
REASONS = ("not_authorized", "selection_material", "relabelled_return", "no_terminal_run", "no_group_plan", "batch_unknown", "batch_contradicts", "group_not_closed")


def own_reasons(episodes: DataFrame, authorized: DataFrame, material: DataFrame, returns: DataFrame, executions: DataFrame, groups: DataFrame, batches: DataFrame) -> DataFrame:
    """(episode_id, reason) by each rule that an episode breaks by itself.

    episodes: episode_id, source_kind, reference. authorized: reference. material: reference (ids of plans of comparisons and
    contrasts and of their requests). returns: reference, stage. executions: reference, run_id, group_id (null: none).
    groups: group_id, update_mode, batch_id, planned, recorded. batches: batch_id, group_id of each member.
    """
    plain = episodes.filter("source_kind <> 'rejected_target_evaluation'")

    def broken(rows: DataFrame, reason: str) -> DataFrame:
        return rows.select("episode_id", F.lit(reason).alias("reason"))

    rejected = episodes.filter("source_kind = 'rejected_target_evaluation'").join(authorized.select("reference").distinct(), "reference", "left_anti")
    selection = plain.join(material.select("reference").distinct(), "reference", "left_semi")
    relabelled = plain.join(returns.filter("stage in ('execute', 'evaluate')").select("reference").distinct(), "reference", "left_semi")
    local = plain.join(executions, "reference")
    planned = local.filter("run_id is not null and group_id is not null").join(groups, "group_id", "left").withColumn("known", F.col("planned").isNotNull())
    frozen = planned.filter("known and update_mode = 'frozen_microbatch'")
    members = batches.groupBy("batch_id").agg(F.collect_set("group_id").alias("members"), F.count("*").alias("listed"))
    batched = frozen.join(members, "batch_id", "left")
    of_batch = batches.join(groups.select("group_id", "update_mode", F.col("batch_id").alias("own_batch"), "planned", "recorded"), "group_id", "left")
    consistent: Column = F.coalesce((F.col("own_batch") == F.col("batch_id")) & (F.col("update_mode") == "frozen_microbatch"), F.lit(False))
    state = of_batch.groupBy("batch_id").agg(F.bool_and(consistent).alias("whole"), F.bool_and(F.coalesce(F.col("planned") == F.col("recorded"), F.lit(False))).alias("closed"))
    checked = batched.filter("members is not null").join(state, "batch_id")
    sound = F.array_contains("members", F.col("group_id")) & (F.size("members") == F.col("listed")) & F.col("whole")
    return (
        broken(rejected, "not_authorized").unionByName(broken(selection, "selection_material")).unionByName(broken(relabelled, "relabelled_return"))
        .unionByName(broken(local.filter("run_id is null"), "no_terminal_run"))
        .unionByName(broken(local.filter("run_id is not null and group_id is null"), "no_group_plan")).unionByName(broken(planned.filter("not known"), "no_group_plan"))
        .unionByName(broken(batched.filter("members is null"), "batch_unknown"))
        .unionByName(broken(checked.filter(~sound), "batch_contradicts"))
        .unionByName(broken(planned.filter("known and planned <> recorded"), "group_not_closed")).unionByName(broken(checked.filter("not closed"), "group_not_closed"))
    )


def rejections(reasons: DataFrame, parents: DataFrame) -> DataFrame:
    """episode_id, reason and whether it is inherited, of every episode that has one or descends from one that does.

    reasons: episode_id, reason. parents: episode_id, parent_id; an episode that names itself, or whose parent is unknown, is no
    descendant by that.
    """
    rank = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")).cast("int")
    own = reasons.groupBy(F.col("episode_id").alias("node")).agg(F.min(rank).alias("label"))
    every = first_labels(parents.select(F.col("episode_id").alias("src"), F.col("parent_id").alias("dst")), own)
    joined = every.join(own.withColumnRenamed("label", "own"), "node", "left")
    named = F.element_at(F.array(*map(F.lit, REASONS)), F.col("label"))
    return joined.select(F.col("node").alias("episode_id"), named.alias("reason"), (F.col("own").isNull() | (F.col("own") > F.col("label"))).alias("inherited"))
