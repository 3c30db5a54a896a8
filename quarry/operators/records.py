"""Operators over stored records: admission, unions, completion, coverage and totals that never count the unknown as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import graph
from quarry.operators.events import interval_union
from quarry.operators.lineage import cut


def captured(observations: DataFrame, as_of: str) -> DataFrame:
    """Candidate items from observations (observation_id, project, session, source, text), with their defaults."""
    now = F.lit(as_of).cast("timestamp")
    kind = T.infer_kind(F.col("text"))
    return observations.select(
        F.concat(F.lit("candidate:"), "observation_id").alias("id"), kind.alias("kind"), F.concat_ws(":", "project", "session").alias("scope"), "source",
        F.lit(0.5).alias("confidence"), F.lit("candidate").alias("status"), F.col("text").alias("content"), F.lit(0).alias("retrieval_count"),
        (kind == "evidence").alias("cross_project_applicable"), F.when(kind == "session", now + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
    )


def record_digest(*columns: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns: keys in order, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def public(rows: DataFrame, private: tuple[str, ...] = ("criteria", "private")) -> DataFrame:
    """The rows without what only an evaluator may see."""
    return rows.drop(*private)


def rules(skills: DataFrame) -> DataFrame:
    """Numbered rules R1, R2, ... of each revision (skill_id, revision, steps)."""
    return skills.select("skill_id", "revision", F.posexplode("steps").alias("i", "text")).select("skill_id", "revision", F.concat(F.lit("R"), F.col("i") + 1).alias("rule_id"), "text")


def scope_selection(skills: DataFrame, query: list[str], description: str) -> DataFrame:
    """Score, or the reason of exclusion, of skills (skill_id, family, triggers, require_any, exclude_any; null without selector).

    A phrase that excludes goes first; a selector then needs one of its phrases; without one the family or a trigger must match.
    """
    q = F.array(*map(F.lit, query))
    said = F.lit(" ".join(description.lower().split()))
    hits = lambda c: F.size(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.contains(said, F.lower(x))))
    family, triggers, required, excluded = F.size(F.array_intersect("family", q)), F.size(F.array_intersect("triggers", q)), hits(F.col("require_any")), hits(F.col("exclude_any"))
    reason = (
        F.when(excluded > 0, "scope_exclusion").when(F.col("require_any").isNotNull() & (required == 0), "scope_requirement")
        .when((family == 0) & (triggers == 0) & (required == 0), "scope_or_trigger")
    )
    return skills.select("skill_id", reason.alias("reason"), F.when(reason.isNull(), (triggers + family + 2 * required).cast("double")).alias("score"))


def group_completion(slots: DataFrame, runs: DataFrame, binding: list[str]) -> DataFrame:
    """Planned slots (group_id, run_id, ...) against the runs there are: missing, unplanned and differing ones of each group."""
    p = slots.select("group_id", "run_id", F.struct(*binding).alias("planned"))
    r = runs.select("group_id", "run_id", F.struct(*binding).alias("actual"))
    both = p.join(r, ["group_id", "run_id"], "full")
    out = both.groupBy("group_id").agg(
        F.count("planned").alias("planned"), F.count("actual").alias("recorded"), F.count_if(F.col("actual").isNull()).alias("missing"),
        F.count_if(F.col("planned").isNull()).alias("unplanned"), F.count_if(F.col("planned") != F.col("actual")).alias("differing"),
    )
    return out.withColumn("complete", (F.col("planned") > 0) & (F.col("missing") + F.col("unplanned") + F.col("differing") == 0))


def union_by_id(first: DataFrame, second: DataFrame, key: str = "id") -> DataFrame:
    """All rows of the first table, and those of the second whose key the first does not have."""
    return first.unionByName(second.join(first.select(key).distinct(), key, "left_anti"))


def touching(events: DataFrame, resources: DataFrame, key: str) -> DataFrame:
    """Events that one of the resources names."""
    return events.join(resources.select(key).distinct(), key, "left_semi")


def state_resources(feedback: DataFrame, events: DataFrame) -> DataFrame:
    """Bound feedback (check_id, episode_id, state_digest, binding) with the environment's result that its digest names, if any."""
    bound = feedback.filter("binding = 'bound' and state_digest is not null")
    made = events.filter("source_role = 'environment' and kind in ('result', 'observation') and artifact is not null")
    made = made.select("episode_id", F.sha2("artifact", 256).alias("state_digest"), "event_id")
    return bound.join(made, ["episode_id", "state_digest"], "left").select("check_id", "episode_id", F.concat(F.lit("evaluated-state:"), "state_digest").alias("ref"), "event_id")


def requirement_coverage(requirements: DataFrame, checks: DataFrame, results: DataFrame) -> DataFrame:
    """Status of requirements over their checks and these' results: failed if any is, passed if all are, else unknown."""
    rows = requirements.join(checks, "requirement_id", "left").join(results, "check_id", "left")
    out = rows.groupBy("requirement_id").agg(
        F.count_if(F.col("outcome") == "fail").alias("failed"), F.count_if(F.col("outcome") == "pass").alias("passed"), F.count("*").alias("n"), F.count("check_id").alias("checks"),
    )
    status = F.when(F.col("failed") > 0, "fail").when((F.col("checks") > 0) & (F.col("passed") == F.col("n")), "pass").otherwise("unknown")
    return out.select("requirement_id", "checks", "passed", "failed", status.alias("status"))


def open_pairs(records: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """The first pairs (a < b) of records that are not among the known ones, in the order of a, then b.

    So many pairs need the first few records as a only: with n records, those before the (limit + known)-th pair.
    """
    n, taken = records.count(), known.distinct().count()
    if n < 2 or limit < 1:
        return records.select(F.col("record_id").alias("a"), F.col("record_id").alias("b")).limit(0)
    firsts, pairs = 0, 0
    while firsts < n - 1 and pairs < limit + taken:
        firsts, pairs = firsts + 1, pairs + n - firsts - 1
    # At most limit + known numbers.
    held = [r[0] for r in records.orderBy("record_id").limit(firsts).collect()]
    pairs = records.select(F.explode(F.lit(held)).alias("a"), F.col("record_id").alias("b")).filter("a < b")
    return pairs.join(known, ["a", "b"], "left_anti").orderBy("a", "b").limit(limit).select("a", "b")


def arm_differences(scores: DataFrame, tasks: DataFrame, base: str) -> DataFrame:
    """Score of each arm against the base arm by task, over all tasks; the gain is null unless both are known."""
    arms = scores.filter(F.col("arm") != base).select("arm").distinct()
    before = scores.filter(F.col("arm") == base).select("task_id", F.col("score").alias("baseline"))
    grid = tasks.select("task_id").distinct().withColumn("arm", F.explode(F.array_sort(F.lit(sorted(r[0] for r in arms.collect())))))  # arms are a handful
    rows = grid.join(before, "task_id", "left").join(scores.select("arm", "task_id", F.col("score").alias("candidate")), ["arm", "task_id"], "left")
    return rows.select("arm", "task_id", "baseline", "candidate", (F.col("candidate") - F.col("baseline")).alias("gain"))


def mean_gains(differences: DataFrame) -> DataFrame:
    """The mean gain of each arm, only if every task's gain is known."""
    whole = F.count("gain") == F.count("*")
    return differences.groupBy("arm").agg(F.count("*").alias("tasks"), F.count("gain").alias("known"), F.round(F.when(whole, F.avg("gain")), 6).alias("mean_gain"))


def ledger_summary(starts: DataFrame, returns: DataFrame, by: str) -> DataFrame:
    """Calls started and what came back (call_ref, status, tokens); a total is given only if every call's tokens are known."""
    rows = starts.join(returns, "call_ref", "left")
    known = F.col("tokens") >= 0
    return rows.groupBy(by).agg(
        F.count("*").alias("calls"), F.sum("input_chars").alias("input_chars"), F.count_if(F.col("status").isNull()).alias("unreturned"),
        F.sum(F.when(known, F.col("tokens"))).alias("known_tokens"), F.count_if(~F.coalesce(known, F.lit(False))).alias("unknown_calls"),
        F.when(F.count_if(known) == F.count("*"), F.sum("tokens")).alias("total_tokens"),
    )


def wall_segments(segments: DataFrame, group: str) -> DataFrame:
    """The last word on each segment (group, segment_id, seq, finished_at, elapsed), and a total only if all ended with a known time."""
    # A finished row replaces what was there; an unfinished one does not, unless it is the first.
    last = F.struct(F.col("finished_at").isNotNull(), F.when(F.col("finished_at").isNotNull(), F.col("seq")).otherwise(-F.col("seq")))
    one = segments.groupBy(group, "segment_id").agg(F.max_by(F.struct("finished_at", "elapsed"), last).alias("x"))
    seconds = F.when(F.col("x.finished_at").isNotNull() & ~F.isnan("x.elapsed") & (F.abs("x.elapsed") < float("inf")), F.col("x.elapsed"))
    out = one.groupBy(group).agg(F.count("*").alias("segments"), F.sum(seconds).alias("known"), (F.count("*") - F.count(seconds)).alias("missing"))
    known = F.round(F.coalesce("known", F.lit(0.0)), 4)
    return out.select(group, "segments", known.alias("known_seconds"), "missing", F.when(F.col("missing") == 0, known).alias("complete_seconds"))


def batch_receipts(segments: DataFrame, batch: str, as_of: str) -> DataFrame:
    """Span from the first start, known seconds and segments without an end (batch, segment_id, status, at, elapsed)."""
    started = segments.filter("status = 'started'").groupBy(batch, "segment_id").agg(F.max("at").alias("at"))
    ended = segments.filter("status <> 'started'").groupBy(batch, "segment_id").agg(F.max_by("elapsed", "at").alias("elapsed"), F.lit(True).alias("ended"))
    rows = started.withColumn("begun", F.lit(True)).join(ended, [batch, "segment_id"], "full")
    out = rows.groupBy(batch).agg(
        F.min("at").alias("first"), F.count("begun").alias("segments"), F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 4).alias("known_seconds"),
        F.count_if(F.col("begun") & F.col("elapsed").isNull()).alias("missing"),
    )
    return out.select(batch, "segments", (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("first").cast("timestamp"))).alias("span_seconds"), "known_seconds", "missing")


def experience_support(records: DataFrame) -> DataFrame:
    """Sets of sources and tasks of all records of one key (key, episode_id, task_id, supports), and how many support it."""
    return records.groupBy("key").agg(
        F.array_sort(F.collect_set("episode_id")).alias("episodes"), F.array_sort(F.collect_set("task_id")).alias("tasks"),
        F.array_sort(F.collect_set(F.when(F.col("supports"), F.col("task_id")))).alias("support"), F.array_sort(F.collect_set(F.when(F.col("task_id").isNull(), F.col("episode_id")))).alias("unknown"),
    ).select("key", F.size("episodes").alias("episodes"), F.size("tasks").alias("tasks"), F.size("support").alias("support_tasks"), F.size("unknown").alias("unknown_episodes"))


def whole_cost(usage: DataFrame, by: str) -> DataFrame:
    """The cost of each actor, null unless all its rows have one and in one currency."""
    whole = (F.count("cost") == F.count("*")) & (F.count("currency") == F.count("*")) & (F.count_distinct("currency") == 1)
    return usage.groupBy(by).agg(F.count("*").alias("calls"), F.round(F.when(whole, F.sum("cost")), 2).alias("cost"), F.when(whole, F.min("currency")).alias("currency"))


def read_coverage(events: DataFrame, fragments: DataFrame) -> DataFrame:
    """Events (event_id, n_bytes) that the fragments' byte ranges show in whole, in part or not at all, counted."""
    rows = events.join(interval_union(fragments, "event_id"), "event_id", "left")
    full = F.coalesce((F.col("islands") == 1) & (F.col("first") <= 0) & (F.col("last") >= F.col("n_bytes")), F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), F.count("islands").alias("projected"), F.count_if(full).alias("full"), F.count_if(F.col("islands").isNotNull() & ~full).alias("truncated"),
        F.count_if(F.col("islands").isNull()).alias("omitted"), (F.count_if(full) == F.count("*")).alias("complete"),
    )


def latest_cycles(records: DataFrame) -> DataFrame:
    """The last record of each cycle that is not a mere plan, or the first plan (cycle_id, seq, status)."""
    done = F.col("status") != "planned"
    return records.groupBy("cycle_id").agg(F.max_by(F.struct("status", "seq"), F.struct(done, F.when(done, F.col("seq")).otherwise(-F.col("seq")))).alias("x")).select("cycle_id", "x.status", "x.seq")


def registry(bases: DataFrame, links: DataFrame) -> DataFrame:
    """Knowledge bases by name: the last row of a name replaces those before; links to projects add to its set, once each."""
    base = bases.groupBy("name").agg(F.max_by(F.struct("root", "projects"), "seq").alias("x")).select("name", "x.root", "x.projects")
    added = links.groupBy("name").agg(F.collect_set("project").alias("added"))
    none = F.array().cast("array<string>")
    return base.join(added, "name", "left").select("name", "root", F.array_sort(F.array_union(F.coalesce("projects", none), F.coalesce("added", none))).alias("projects"))


def standing(assessments: DataFrame) -> DataFrame:
    """Assessments that no later one supersedes; the rows themselves are only ever added to."""
    gone = assessments.select(F.col("supersedes").alias("assessment_id")).filter("assessment_id is not null").distinct()
    return assessments.join(gone, "assessment_id", "left_anti")


def execution_view(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, background: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Seeds, background and all that they depend on: each node with its part in the view, and whether the view can run.

    ``problem`` names what stops it: a missing node, one of a cycle, or one in a declared conflict with another of the view.
    """
    roots = seeds.select("node").union(background.select("node")).distinct()
    reached = cut(graph.reached_nodes(edges, roots))
    inside = edges.join(reached.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst")
    loops = inside.filter("src = dst").select(F.col("src").alias("node"))
    cyclic = graph.strong_components(inside).select("node").union(loops).distinct().withColumn("cyclic", F.lit(True))
    pairs = conflicts.join(reached.select(F.col("node").alias("a")), "a", "left_semi").join(reached.select(F.col("node").alias("b")), "b", "left_semi")
    fought = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("fought", F.lit(True))
    rows = reached.join(nodes.select("node", F.lit(True).alias("there")), "node", "left").join(cyclic, "node", "left").join(fought, "node", "left")
    rows = rows.join(seeds.select("node", F.lit(True).alias("seed")).distinct(), "node", "left").join(background.select("node", F.lit(True).alias("ground")).distinct(), "node", "left")
    part = F.when(F.col("seed"), "seed").when(F.col("ground"), "background").otherwise("dependency")
    problem = F.when(F.col("there").isNull(), "missing").when(F.col("cyclic"), "cycle").when(F.col("fought"), "conflict")
    return rows.select("node", part.alias("part"), problem.alias("problem"))


def packet_union(packets: DataFrame) -> DataFrame:
    """References of several packets (packet_id, seq, ref_id, excerpt), each once, as the first packet has it."""
    return packets.groupBy("ref_id").agg(F.min_by(F.struct("packet_id", "excerpt"), "seq").alias("x")).select("ref_id", "x.packet_id", "x.excerpt")


def inventory_differences(declared: DataFrame, stored: DataFrame) -> DataFrame:
    """Assets (owner, path, digest) that only one side has."""
    side = lambda a, b, name: a.join(b, a.columns, "left_anti").withColumn("side", F.lit(name))
    return side(declared, stored, "declared").unionByName(side(stored, declared, "stored"))


def effect_witnesses(relations: DataFrame, results: DataFrame) -> DataFrame:
    """Measured effects (relation_id, plan_id, value) with how many results bear them out; exactly one makes them applicable."""
    found = results.groupBy("plan_id", "relation_id", "value").agg(F.count("*").alias("witnesses"))
    rows = relations.join(found, ["plan_id", "relation_id", "value"], "left").withColumn("witnesses", F.coalesce("witnesses", F.lit(0)).cast("long"))
    return rows.select("relation_id", "witnesses", F.when(F.col("witnesses") != 1, "contrast_evidence").alias("reason"))


def call_metadata(events: DataFrame, limit: int) -> DataFrame:
    """A bounded spread of events over episodes, with up to two other events of each one's call (T9 and its partners)."""
    from quarry.operators.events import spread

    chosen = spread(events, limit).select("event_id")
    calls = events.join(chosen, "event_id", "left_semi").filter("call_id is not null").select("episode_id", "call_id").distinct()
    w = Window.partitionBy("episode_id", "call_id").orderBy("position")
    partners = events.join(calls, ["episode_id", "call_id"], "left_semi").withColumn("r", F.row_number().over(w)).filter("r <= 2").select("event_id")
    return chosen.union(partners).distinct()


def appended(facts: DataFrame, new: DataFrame) -> DataFrame:
    """New facts (memory_id, record_id, content) with the revision after the last one of their memory, which they supersede."""
    last = facts.groupBy("memory_id").agg(F.max("revision").alias("revision"), F.max_by("record_id", "revision").alias("supersedes"))
    w = Window.partitionBy("memory_id").orderBy("record_id")
    rows = new.join(last, "memory_id", "left").withColumn("n", F.row_number().over(w))
    before = F.when(F.col("n") == 1, F.col("supersedes")).otherwise(F.lag("record_id").over(w))
    return rows.select("memory_id", "record_id", "content", (F.coalesce("revision", F.lit(0)) + F.col("n")).alias("revision"), before.alias("supersedes"))


def snapshots(rows: DataFrame, *columns: str) -> DataFrame:
    """Content-addressed rows: the digest of the named columns is the id, and the same content is one row."""
    return rows.select(record_digest(*columns).alias("snapshot_id"), *columns).dropDuplicates(["snapshot_id"])


def visible_facts(facts: DataFrame, project: str) -> DataFrame:
    """The last revision of each memory, of those that belong to the user or to this project."""
    kept = facts.filter((F.col("kind") == "user") | (F.col("project") == project))
    return kept.groupBy("memory_id").agg(F.max_by(F.struct("record_id", "kind"), "revision").alias("x")).select("memory_id", "x.record_id", "x.kind")


def with_latest(proposals: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Proposals with their last evaluation (proposal_id, at, decision), if they have one."""
    last = evaluations.groupBy("proposal_id").agg(F.max_by("decision", "at").alias("decision"), F.max("at").alias("evaluated_at"))
    return proposals.join(last, "proposal_id", "left")


def search_results(rows: DataFrame, limit: int) -> DataFrame:
    """Answers of a search service in one shape: path or file, title or the file's name, excerpt or snippet or content."""
    path = F.coalesce("path", "file", F.lit(""))
    name = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")
    few = rows.orderBy("place").limit(limit)
    return few.select("place", path.alias("path"), F.coalesce("title", name).alias("title"), T.excerpt(F.coalesce("excerpt", "snippet", "content", F.lit("")), 240).alias("excerpt"))


def session_summary(rows: DataFrame, source: str, **sections: str) -> DataFrame:
    """The text of a session's summary: its source and a list for each section (title with underscores = array column)."""
    bullets = lambda c: F.when(F.size(c) > 0, F.concat_ws("\n", F.transform(c, lambda x: F.concat(F.lit("- "), x)))).otherwise(F.lit("- none"))
    parts = [F.lit("# Session Summary\n\n## Source\n"), F.concat(F.lit("- "), source)]
    for title, column in sections.items():
        parts += [F.lit(f"\n## {title.replace('_', ' ')}\n"), bullets(column)]
    return rows.withColumn("summary", F.concat(F.concat_ws("\n", *parts), F.lit("\n")))


def obligations(proposals: DataFrame) -> DataFrame:
    """Requirements of proposals that share a snapshot (snapshot, source, place, check): each source's once, whoever names it."""
    return proposals.select("snapshot", record_digest("source", "place", "check").alias("requirement_id"), "source", "check").dropDuplicates(["snapshot", "requirement_id"])


def review_counts(reviews: DataFrame, relations: DataFrame) -> DataFrame:
    """Reviews by status, with the revocations that the applied ones committed (relation_id, op)."""
    revoked = relations.filter("op = 'REVOKE'").select("relation_id").distinct().withColumn("revoked", F.lit(1))
    rows = reviews.join(revoked, "relation_id", "left")
    return rows.groupBy("status").agg(F.count("*").alias("reviews"), F.count(F.when(F.col("status") == "applied", F.col("revoked"))).alias("revocations"))
