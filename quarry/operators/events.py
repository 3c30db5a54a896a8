"""Event logs: call pairing, links, goal transitions, segments and interval coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T


def call_pairs(events: DataFrame) -> DataFrame:
    """Calls by episode: paired with exactly one action and at least one result, else ambiguous."""
    g = events.filter("call_id is not null").groupBy("episode_id", "call_id").agg(
        F.count_if(F.col("kind") == "action").alias("actions"), F.count_if(F.col("kind").isin("result", "observation")).alias("results"))
    return g.withColumn("state", F.when((F.col("actions") == 1) & (F.col("results") >= 1), "paired").otherwise("ambiguous"))


def parent_links(events: DataFrame) -> DataFrame:
    """The state of each declared parent: missing, in another episode, later than the child, or linked."""
    parents = events.select(F.col("event_id").alias("_p"), F.col("episode_id").alias("_e"), F.col("position").alias("_at"))
    j = events.filter("parent_event_id is not null").join(parents, F.col("parent_event_id") == F.col("_p"), "left")
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_e") != F.col("episode_id"), "cross_episode").when(F.col("_at") >= F.col("position"), "out_of_order").otherwise("linked")
    return j.select("event_id", "parent_event_id", state.alias("state"))


def resource_links(events: DataFrame) -> DataFrame:
    """Pairs of events of one episode on one resource, in order, with whether versions match and a declared parent."""
    side = lambda s: events.filter("resource is not null").select("episode_id", "resource", *[F.col(c).alias(f"{c}_{s}") for c in ("event_id", "position", "version_ref", "parent_event_id")])
    j = side("a").join(side("b"), ["episode_id", "resource"]).filter("position_a < position_b")
    parent = F.coalesce(F.col("parent_event_id_b") == F.col("event_id_a"), F.lit(False)) | F.coalesce(F.col("parent_event_id_a") == F.col("event_id_b"), F.lit(False))
    return j.select("episode_id", "resource", F.col("event_id_a").alias("first_id"), F.col("event_id_b").alias("second_id"), (F.col("version_ref_a") == F.col("version_ref_b")).alias("version_match"), F.when(parent, "declared_parent").otherwise("same_resource_candidate").alias("relation"))


def goal_transitions(events: DataFrame) -> DataFrame:
    """How each user message's goal follows from those before: continues, revises, resumes, switches or ambiguous."""
    users = events.filter("kind = 'user_message'")
    key = F.when(F.col("goal_id").isNotNull() & F.col("task_revision").isNotNull(), F.struct(F.col("goal_id").alias("goal"), F.col("task_revision").alias("revision")))
    users = users.withColumn("_key", key)
    before = Window.partitionBy("episode_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    users = users.withColumn("_last", F.last("_key", ignorenulls=True).over(before))
    users = users.withColumn("_first", F.min("position").over(Window.partitionBy("episode_id", "_key")))
    state = (
        F.when(F.col("_key").isNull(), "ambiguous").when(F.col("_last").isNull() | (F.col("_last") == F.col("_key")), "continues")
        .when(F.col("_last.goal") == F.col("_key.goal"), "revises").when(F.col("_first") < F.col("position"), "resumes").otherwise("switches")
    )
    return users.select("event_id", "episode_id", "position", state.alias("transition"))


def segments(events: DataFrame, cap: int) -> DataFrame:
    """Runs of events with one goal, cut into pieces of at most ``cap`` events."""
    w = Window.partitionBy("episode_id").orderBy("position")
    e = events.withColumn("_new", (~F.lag("goal_id").over(w).eqNullSafe(F.col("goal_id"))).cast("int"))
    e = e.withColumn("_run", F.sum("_new").over(w))
    inner = Window.partitionBy("episode_id", "_run").orderBy("position")
    e = e.withColumn("_piece", F.floor((F.row_number().over(inner) - 1) / cap).cast("long"))
    return e.groupBy("episode_id", "_run", "_piece").agg(F.min("position").alias("start"), F.max("position").alias("stop"), F.count("*").alias("events"), F.max("goal_id").alias("goal_id")).drop("_run", "_piece")


def segment_priority(events: DataFrame, cap: int, keep: int) -> DataFrame:
    """The segments of each episode that matter most: failures, then users, results, actions; the cap comes after."""
    rank = F.when(F.col("kind") == "failed", 0).when(F.col("kind") == "user_message", 1).when(F.col("kind").isin("result", "observation"), 2).when(F.col("kind") == "action", 3).otherwise(5)
    s = segments(events, cap)
    j = s.join(events.select(F.col("episode_id").alias("_e"), "position", rank.alias("_r")), (F.col("episode_id") == F.col("_e")) & F.col("position").between(F.col("start"), F.col("stop")))
    p = j.groupBy("episode_id", "start", "stop").agg(F.min("_r").cast("int").alias("priority"))
    w = Window.partitionBy("episode_id").orderBy("priority", "start")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def preceding_user(events: DataFrame) -> DataFrame:
    """For each other event the nearest user message before it in the episode."""
    w = Window.partitionBy("episode_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(F.when(F.col("kind") == "user_message", F.col("event_id")), ignorenulls=True).over(w)
    return events.withColumn("user_event_id", found).filter("kind <> 'user_message'").select("event_id", "episode_id", "user_event_id")


def interval_union(spans: DataFrame, key: str) -> DataFrame:
    """Covered length and number of islands of the intervals [start, stop) of each key."""
    w = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("_reach", reach)
    s = s.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).cast("long"))
    fresh = F.greatest(F.col("stop") - F.greatest(F.col("start"), F.coalesce("_reach", F.col("start"))), F.lit(0))
    return s.withColumn("_fresh", fresh).groupBy(key).agg(F.sum("_fresh").alias("covered"), F.sum("_new").alias("islands"), F.min("start").alias("first"), F.max("stop").alias("last"))


def overlapping_chunks(reads: DataFrame, chunk: int) -> DataFrame:
    """Chunks of fixed size that a byte range [start, stop) touches, with the part of each that is read."""
    numbers = F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("stop") - 1) / chunk))
    c = reads.filter("stop > start").select("*", F.explode(numbers).alias("chunk_no"))
    return c.withColumns({"chunk_start": F.greatest(F.col("start") - F.col("chunk_no") * chunk, F.lit(0)), "chunk_stop": F.least(F.col("stop") - F.col("chunk_no") * chunk, F.lit(chunk))})


def turns(rows: DataFrame, *order: str, within: tuple[str, ...] = ()) -> DataFrame:
    """Adds the turn of each row in its episode: both ends of the episode first, then middles of middles."""
    w = Window.partitionBy(*within, "episode_id").orderBy(*order)
    e = rows.withColumn("_at", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*within, "episode_id")))
    e = e.withColumn("_depth", T.middle_depth(F.col("_at"), F.col("_n")))
    return e.withColumn("turn", F.row_number().over(Window.partitionBy(*within, "episode_id").orderBy("_depth", "_at"))).drop("_at", "_n", "_depth")


def spread(events: DataFrame, limit: int) -> DataFrame:
    """Round-robin over episodes, each spread over its positions, up to a limit."""
    e = turns(events, "position", "event_id").filter(F.col("turn") <= limit)
    return e.orderBy("turn", "episode_id").limit(limit).select("turn", "episode_id", "event_id")


def selection_units(events: DataFrame, focus: DataFrame) -> DataFrame:
    """Calls (or single events) as units, in classes of priority and spread over episodes within each.

    In focus comes first, then tasks, feedback and the last event of an episode, then recoveries, counterexamples and
    failures, then the rest; a unit has the best class of its members (episode_id, event_id, position, call_id, kind,
    failed). The order of the result is (priority, turn, episode_id).
    """
    last = F.max("position").over(Window.partitionBy("episode_id"))
    e = events.join(focus.select("event_id", F.lit(True).alias("focus")), "event_id", "left").withColumn("last", last)
    rank = (
        F.when(F.col("focus"), -1).when(F.col("kind").isin("task", "feedback") | (F.col("position") == F.col("last")), 0)
        .when(F.col("kind").isin("recovery", "counterexample") | F.col("failed"), 1).otherwise(2)
    )
    unit = F.coalesce(F.concat(F.lit("c"), F.col("call_id")), F.concat(F.lit("e"), F.col("event_id")))
    units = e.withColumn("priority", rank).groupBy("episode_id", unit.alias("unit")).agg(F.min("priority").alias("priority"), F.min("position").alias("position"), F.count("*").alias("members"))
    return turns(units, "position", "unit", within=("priority",)).select("priority", "turn", "episode_id", "unit", "position", "members")


def co_use(consumed: DataFrame, key: str, item: str) -> DataFrame:
    """Pairs of different items used together, with the number of keys that did."""
    items = consumed.select(key, item).distinct()
    a, b = items.select(key, F.col(item).alias("first")), items.select(key, F.col(item).alias("second"))
    return a.join(b, key).filter("first < second").groupBy("first", "second").agg(F.count("*").alias("uses"))


def trace_rows(events: DataFrame, where: str, limit: int | None = None) -> DataFrame:
    """Metadata of the events that meet a condition, in order of position; the first ``limit`` of them, if one is given."""
    rows = events.filter(where).orderBy("position", "event_id")
    return rows if limit is None else rows.limit(limit)


def select_metadata(events: DataFrame, focus: DataFrame, limit: int) -> DataFrame:
    """A bounded choice of each trace's events, in the order of choosing: trace, place, event_id, never more than ``limit`` of a trace.

    events: trace, event_id, position (from 0, without gaps), call_id, marked (task, feedback, recovery, counterexample or failed).
    First come the events in focus, then a probe of the trace at its ends and middles of middles: the next marked event and
    the next event of any kind, each with up to two events of its call. Only as many probes as the limit are made, so a trace's
    choice is a fold over a short array.
    """
    to_end = Window.partitionBy("trace").orderBy("position").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("trace")
    rows = events.select("trace", "event_id", F.col("position").cast("long").alias("position"), "call_id", F.coalesce("marked", F.lit(False)).alias("marked"))
    rows = rows.withColumn("next", F.min(F.when(F.col("marked"), F.col("position"))).over(to_end)).withColumn("n", F.count("*").over(whole))
    depth = T.middle_depth(F.col("position"), F.col("n"))
    probes = rows.withColumn("turn", F.row_number().over(whole.orderBy(depth, "position"))).filter(F.col("turn") <= limit)
    call = Window.partitionBy("trace", "call_id").orderBy("position")
    members = rows.filter("call_id is not null").withColumn("r", F.row_number().over(call)).filter("r <= 2")
    partners = members.groupBy("trace", "call_id").agg(F.array_sort(F.collect_list("position")).alias("partners"))
    entry = rows.select("trace", "position", "call_id").join(partners, ["trace", "call_id"], "left").select("trace", "position", F.coalesce("partners", F.array().cast("array<bigint>")).alias("partners"))
    wanted = probes.select("trace", "turn", F.posexplode(F.array("next", "position")).alias("part", "position")).filter("position is not null")
    steps = wanted.join(entry, ["trace", "position"]).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("turn", "part", "position", "partners"))).alias("steps"))
    first = rows.join(focus.select("event_id").distinct(), "event_id", "left_semi").withColumn("r", F.row_number().over(whole.orderBy("position"))).filter(F.col("r") <= limit)
    given = first.groupBy("trace").agg(F.array_sort(F.collect_list("position")).alias("given"))

    def take(chosen: Column, step: Column) -> Column:
        own = F.array_union(chosen, F.array(step["position"]))
        more = F.array_union(own, F.slice(step["partners"], F.lit(1), F.least(F.lit(2), F.greatest(limit - F.size(own), F.lit(0)))))
        return F.when(F.size(chosen) >= limit, chosen).otherwise(more)

    start = F.coalesce("given", F.array().cast("array<bigint>"))
    chosen = steps.join(given, "trace", "left").select("trace", F.posexplode(F.slice(F.aggregate("steps", start, take), 1, limit)).alias("place", "position"))
    return chosen.join(rows.select("trace", "position", "event_id"), ["trace", "position"]).select("trace", "place", "event_id")
