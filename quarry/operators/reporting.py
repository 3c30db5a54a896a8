"""What a project's records say about its progress, as rows (section, metric, key, value): a metric that is counted by kinds has
a row for each key, and a metric without rows to count is there with the value 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.latest import latest

#: Slots that came to an end, and the levels of use that an execution may report.
FINISHED, LEVELS = ("candidate", "error", "noop"), ("read", "behavior")


def totals(rows: DataFrame, section: str, **metrics: Column) -> DataFrame:
    """One row for each metric, an aggregate over all rows; none of it is 0."""
    one = rows.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in metrics.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("metric"), F.lit(None).cast("string").alias("key"), F.col(n).alias("value")) for n in metrics])))


def by_key(rows: DataFrame, section: str, metric: str, key: Column) -> DataFrame:
    return rows.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("value")).select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "key", "value")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def proposal_attempts(slots: DataFrame) -> DataFrame:
    """slots: status. Planned and finished ones, and all by status."""
    return together(
        totals(slots, "proposals", planned_slots=F.count("*"), finished_slots=F.count_if(F.col("status").isin(*FINISHED))),
        by_key(slots, "proposals", "slot_status", F.col("status")),
    )


def consumption_layers(selected: DataFrame, reported: DataFrame, effects: DataFrame) -> DataFrame:
    """What was supplied, what executions report to have used, and what was measured, apart from each other.

    selected: manifest_id, skill_id, revision. reported: run_id, place of the event that the run points to, and declared, the array of
    struct<skill_id, level> of its execution. A pointer beyond the declared events counts for nothing, and a level other than
    the known ones is unclassified. effects: status.
    """
    named = selected.select(F.concat_ws("@", "skill_id", "revision").alias("skill"), "manifest_id").distinct()
    there = reported.filter((F.col("place") >= 0) & (F.col("place") < F.size("declared"))).withColumn("event", F.get("declared", F.col("place")))
    level = F.when(F.col("event.level").isin(*LEVELS), F.col("event.level")).otherwise("unclassified")
    return together(
        by_key(named, "consumption", "provided_manifests", F.col("skill")), by_key(there, "consumption", "observed_level", level),
        by_key(there, "consumption", "observed_skill", F.col("event.skill_id")), by_key(effects, "consumption", "effect_status", F.col("status")),
    )


def memory_progress(manifests: DataFrame, checkpoints: DataFrame, bindings: DataFrame, cycles: DataFrame, diagnoses: DataFrame) -> DataFrame:
    """How far traces are indexed and goals bound, and what retrieval and reading took.

    manifests: trace_id, byte_length. checkpoints: trace_id, next_raw_byte, created_at, event_count, index_complete; the furthest one of a
    trace counts. bindings: status, resolved. cycles: cycle_id, signature_hits, range_reads, body_bytes, segments (array of statuses). diagnoses: verdict.
    """
    at = latest(checkpoints, "trace_id", F.col("next_raw_byte"), F.col("created_at"))
    traces = manifests.join(at.select("trace_id", "event_count", "index_complete"), "trace_id", "left")
    open_ = ~F.coalesce("index_complete", F.lit(False))
    return together(
        totals(traces, "progress", traces=F.count("*"), archived_bytes=F.sum("byte_length"), indexed_events=F.sum("event_count"), incomplete_traces=F.count_if(open_)),
        totals(bindings, "progress", derived_goal_bindings=F.sum("resolved")), by_key(bindings, "progress", "goal_binding_status", F.col("status")),
        totals(cycles, "progress", signature_hits=F.sum("signature_hits"), range_reads=F.sum("range_reads"), body_bytes=F.sum("body_bytes")),
        by_key(cycles.select(F.explode("segments").alias("s")), "progress", "segment_status", F.col("s")),
        by_key(diagnoses, "progress", "necessity_verdict", F.coalesce("verdict", F.lit("legacy_unrecorded"))),
    )
