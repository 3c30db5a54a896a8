"""Evidence around events: paired context, bounded dependencies, signatures, related experiences and obligations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.graph import reached_nodes
from quarry.operators.lineage import cut


def compatible(a: str, b: str):
    """Equal, or one of them unknown."""
    return F.col(a).isNull() | F.col(b).isNull() | (F.col(a) == F.col(b))


def paired_context(events: DataFrame) -> DataFrame:
    """For each action its results of the same call, and the other way round, unless revisions or goals contradict."""
    side = lambda s: events.filter("call_id is not null").select("episode_id", "call_id", *[F.col(c).alias(f"{c}_{s}") for c in ("event_id", "kind", "task_revision", "goal_id")])
    j = side("a").join(side("b"), ["episode_id", "call_id"])
    results = ("result", "observation")
    opposite = ((F.col("kind_a") == "action") & F.col("kind_b").isin(*results)) | (F.col("kind_a").isin(*results) & (F.col("kind_b") == "action"))
    fits = compatible("task_revision_a", "task_revision_b") & compatible("goal_id_a", "goal_id_b")
    return j.filter(opposite & fits).select(F.col("event_id_a").alias("event_id"), F.col("event_id_b").alias("context_id"))


def dependencies(links: DataFrame, focus: DataFrame, max_hops: int, max_events: int) -> DataFrame:
    """Events within so many links (src, dst, either way) of the focus, nearest first and at most so many."""
    both = cut(links.select("src", "dst").unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct())
    seen = cut(focus.select(F.col("node")).distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, max_hops + 1):
        step = front.join(both, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen.filter("hop > 0").orderBy("hop", "node").limit(max_events)


def failure_signature(events: DataFrame, feedback: DataFrame, by: str) -> DataFrame:
    """Failed criteria, resource kinds and failure terms of each group, sorted."""
    terms = events.select(by, F.explode("failure_terms").alias("t")).distinct().groupBy(by).agg(F.array_sort(F.collect_list("t")).alias("error_codes"))
    kinds = events.filter("resource is not null").select(by, "resource").distinct().groupBy(by).agg(F.array_sort(F.collect_list("resource")).alias("resource_kinds"))
    failed = feedback.filter("outcome = 'fail'").select(by, "criterion_id").distinct().groupBy(by).agg(F.array_sort(F.collect_list("criterion_id")).alias("criterion_ids"))
    out = terms.join(kinds, by, "full").join(failed, by, "full")
    none = F.array().cast("array<string>")
    return out.select(by, *[F.coalesce(c, none).alias(c) for c in ("criterion_ids", "error_codes", "resource_kinds")])


def related(experiences: DataFrame, query: list[str], limit: int) -> DataFrame:
    """Experiences (record_id, terms, signature_score, has_evidence) by common terms and failures; none in common, none kept."""
    lexical = F.size(F.array_intersect("terms", F.array(*map(F.lit, query))))
    scored = experiences.withColumn("score", (lexical + F.col("signature_score")).cast("long")).filter("score > 0")
    return scored.orderBy(F.col("score").desc(), F.col("has_evidence").desc(), F.col("record_id").desc()).limit(limit)


def obligation_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """Required pairs (a, b, required) always, and the first of the others up to the number in all."""
    one = pairs.groupBy("a", "b").agg(F.max("required").alias("required"))
    n = one.filter("required").count()
    rest = one.filter("not required").orderBy("a", "b").limit(max(0, most - n))
    return one.filter("required").unionByName(rest)


def tail(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col(order).desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def admissible(sources: DataFrame, parents: DataFrame, barred: DataFrame) -> DataFrame:
    """Records whose sources and all their ancestors are not barred: no ancestor may be in the barred set."""
    bad = reached_nodes(parents.select(F.col("dst").alias("src"), F.col("src").alias("dst")), barred).withColumnRenamed("node", "source")
    hit = sources.join(bad, "source", "left_semi").select("record").distinct()
    return sources.select("record").distinct().join(hit, "record", "left_anti")


def newer_boundary(bindings: DataFrame, users: DataFrame) -> DataFrame:
    """Bindings (episode_id, anchor, position) between whose anchor and event another user message lies."""
    u = users.select(F.col("episode_id").alias("_e"), F.col("position").alias("_p"))
    inside = (F.col("episode_id") == F.col("_e")) & (F.col("_p") > F.col("anchor")) & (F.col("_p") <= F.col("position"))
    return bindings.join(u, inside, "left_semi")


def visible(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback that adaptation may see, and gap rows for what it may not."""
    shown = F.coalesce(F.col("visibility") == "adaptation", F.lit(False))
    return feedback.filter(shown), feedback.filter(~shown).select("check_id", F.lit("hidden_feedback").alias("gap"))


def reading_hits(tasks: DataFrame, links: DataFrame, pages: DataFrame, most: int) -> DataFrame:
    """For each task (task_id, word) the first pages of its linked bases (task_id, base) that contain the word."""
    j = tasks.join(links, "task_id").join(pages, "base").filter(F.lower("text").contains(F.lower(F.col("word"))))
    w = Window.partitionBy("task_id", "base").orderBy("path")
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).select("task_id", "base", "rank", "path")
