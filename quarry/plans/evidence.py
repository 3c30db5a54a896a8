"""Queries over evidence: decisions, paired context, dependencies, signatures and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import evidence as V
from quarry.plans.registry import ORACLES, query
from quarry.plans.runs import EVENTS, events
from quarry.sources import adapters
from quarry.sources.adapters import table, with_sql


@query
def verification_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.memory_items(spark, sf_dir)
    return m.select("id", T.verification(F.col("kind"), F.size("references")).alias("decision"), T.promotion_refusal(F.col("kind"), F.col("scope"), F.col("status"), F.col("source_hash")).alias("refusal"))


ORACLES["verification_decisions"] = with_sql("memory_items") + """
SELECT id, CASE WHEN kind = 'session' THEN 'rejected' WHEN kind = 'personal' AND len(refs) < 2 THEN 'needs_more_evidence' WHEN len(refs) > 0 THEN 'verified' ELSE 'needs_more_evidence' END AS decision,
 CASE WHEN trim(scope) = '' THEN 'no scope' WHEN status <> 'verified' THEN 'not verified' WHEN kind = 'session' THEN 'session' WHEN kind = 'evidence' AND source_hash IS NULL THEN 'no source' END AS refusal FROM memory_items"""


@query
def session_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    label = F.element_at(F.array(*map(F.lit, ("Decision", "todos", "SOURCE", "open question", "Note", "other"))), (F.col("turn") % 6 + 1).cast("int"))
    line = F.concat(label, F.lit(" :  turn "), F.col("turn"), F.lit(" \r\nplain\r\n"))
    t = c.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"])).alias("t"))
    return t.select("conv_id", F.explode(T.session_lines(F.col("t"))).alias("x")).groupBy("conv_id", "x.section").agg(F.count("*").alias("lines"), F.min("x.value").alias("first"))


ORACLES["session_sections"] = """SELECT conv_id, ['decisions','todos','evidence','open_questions','notes'][turn % 6 + 1] AS section, count(*) AS lines, min('turn ' || turn) AS first
FROM conversations WHERE turn % 6 < 5 GROUP BY ALL"""


@query
def failure_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = F.concat(F.when(i % 2 == 0, '{"error": null} ').otherwise("plain "), F.when(i % 3 == 0, "then it failed here").when(i % 3 == 1, '"Error": [] ok').otherwise("KeyError raised"))
    return table(spark, sf_dir, "events").select("event_id", T.failure_position(t).alias("at"), T.event_role(F.col("event_type"), F.concat(t, F.when(i % 7 == 0, " and a Retry").otherwise(""))).alias("role"))


ORACLES["failure_positions"] = """SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN n + 8 WHEN 2 THEN n END AS INTEGER) AS at, CASE WHEN event_id % 7 = 0 THEN 'recovery' ELSE 'observation' END AS role
FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 16 ELSE 6 END AS n FROM events)"""


@query
def execution_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % n + 1).cast("int"))
    s = T.execution_status(pick(5, "completed", "timeout", None, "odd", "budget_exhausted"), i % 3 != 0, pick(7, None, None, None, None, "cancelled", "boom", None), "available_artifact")
    return o.select(s.alias("s")).groupBy("s.execution_status", "s.eligible").agg(F.count("*").alias("runs"))


ORACLES["execution_statuses"] = """WITH x AS (SELECT coalesce(['completed','timeout',NULL,'odd','budget_exhausted'][o_orderkey % 5 + 1], 'completed') AS s, o_orderkey % 3 <> 0 AS art,
 [NULL,NULL,NULL,NULL,'cancelled','boom',NULL][o_orderkey % 7 + 1] AS err FROM orders),
y AS (SELECT *, CASE WHEN err = 'cancelled' THEN 'cancelled' WHEN err IS NOT NULL THEN 'adapter_error' WHEN s = 'odd' THEN 'adapter_error' WHEN NOT art AND s = 'completed' THEN 'adapter_error' ELSE s END AS e FROM x)
SELECT e AS execution_status, err IS NULL AND art AND e <> 'adapter_error' AS eligible, count(*) AS runs FROM y GROUP BY ALL"""


def scored_facts(d: DataFrame, text: Column) -> DataFrame:
    i = F.col("doc_id")
    none = F.array().cast("array<string>")
    tasks = F.when(i % 5 == 0, F.array(F.lit("t1"), F.lit("t2"))).when(i % 5 == 1, F.array(F.lit("t9"))).otherwise(none)
    words = F.when(i % 5 == 2, F.array(F.lit("import"))).otherwise(none)
    s = T.fact_score(F.when(i % 2 == 0, "user").otherwise("project"), i % 11 == 0, tasks, words, T.terms(text), "t1", ["thing", "has", "ha", "en"])
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.reason")


@query
def fact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_facts(table(spark, sf_dir, "documents"), F.col("text"))


ORACLES["fact_scores"] = """WITH x AS (SELECT doc_id AS i, len(list_filter(['thing','has','ha','en'], lambda q: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), q))) AS o FROM documents)
SELECT i AS doc_id, CAST(CASE WHEN i % 11 = 0 THEN 1 WHEN i % 5 IN (1, 2) THEN NULL WHEN i % 5 = 0 OR i % 2 = 0 THEN o + 1 WHEN o > 0 THEN o END AS DOUBLE) AS score,
 CASE WHEN i % 11 = 0 THEN 'declared_global' WHEN i % 5 IN (1, 2) THEN 'task_relevance' WHEN i % 5 = 0 THEN 'declared_applicability' WHEN i % 2 = 0 THEN 'legacy_user_unspecified_applicability'
  WHEN o > 0 THEN 'lexical_task_overlap' ELSE 'task_relevance' END AS reason FROM x"""


@query
def asset_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    out = T.asset_decision(F.when(i % 2 == 0, "compile").otherwise("run"), i % 7 != 0, F.when(i % 3 != 0, i % 4 == 0), i % 11 == 0, i % 5 != 0, F.when(i % 13 != 0, i % 3), F.col("p_size") > 20)
    return p.select(out.alias("decision")).groupBy("decision").agg(F.count("*").alias("assets"))


ORACLES["asset_decisions"] = """SELECT CASE WHEN i % 7 = 0 THEN 'unknown' WHEN i % 2 = 0 THEN CASE WHEN i % 3 = 0 THEN 'unknown' WHEN i % 4 = 0 THEN 'pass' ELSE 'fail' END
 WHEN i % 11 = 0 OR i % 5 = 0 OR i % 13 = 0 THEN 'unknown' WHEN i % 3 = 0 AND p_size > 20 THEN 'pass' ELSE 'fail' END AS decision, count(*) AS assets FROM (SELECT p_partkey AS i, p_size FROM part) GROUP BY ALL"""


@query
def paired_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.paired_context(events(spark, sf_dir))


ORACLES["paired_context"] = EVENTS + """
SELECT a.event_id, b.event_id AS context_id FROM episode_events a JOIN episode_events b ON a.episode_id = b.episode_id AND a.call_id = b.call_id
WHERE ((a.kind = 'action' AND b.kind IN ('result','observation')) OR (a.kind IN ('result','observation') AND b.kind = 'action'))
 AND (a.task_revision IS NULL OR b.task_revision IS NULL OR a.task_revision = b.task_revision) AND (a.goal_id IS NULL OR b.goal_id IS NULL OR a.goal_id = b.goal_id)"""


@query
def event_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    parents = e.filter("parent_event_id is not null").select(F.col("event_id").alias("src"), F.col("parent_event_id").alias("dst"))
    calls = e.filter("call_id is not null and kind = 'action'").select("episode_id", "call_id", F.col("event_id").alias("src")).join(e.filter("kind = 'result'").select("episode_id", "call_id", F.col("event_id").alias("dst")), ["episode_id", "call_id"]).select("src", "dst")
    focus = e.filter("event_id % 500 = 6").select(F.col("event_id").alias("node"))
    return V.dependencies(parents.unionByName(calls), focus, 2, 200)


ORACLES["event_dependencies"] = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
l AS (SELECT event_id AS a, parent_event_id AS b FROM episode_events WHERE parent_event_id IS NOT NULL
 UNION SELECT x.event_id, y.event_id FROM episode_events x JOIN episode_events y ON x.episode_id = y.episode_id AND x.call_id = y.call_id AND x.kind = 'action' AND y.kind = 'result'),
b AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, hop) AS (SELECT event_id, 0 FROM episode_events WHERE event_id % 500 = 6 UNION SELECT b.b, r.hop + 1 FROM r JOIN b ON r.node = b.a WHERE r.hop < 2)
SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM r GROUP BY node HAVING min(hop) > 0 ORDER BY hop, node LIMIT 200"""


@query
def failure_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("failure_terms", T.failure_terms(F.concat(F.lit("x DISK_ERROR_"), F.col("event_id") % 3, F.when(F.col("kind") == "failed", " KeyError").otherwise(""))))
    feedback = events(spark, sf_dir).select("episode_id", F.col("goal_id").alias("criterion_id"), F.when(F.col("kind") == "failed", "fail").otherwise("pass").alias("outcome")).filter("criterion_id is not null")
    s = V.failure_signature(e, feedback, "episode_id")
    return s.select("episode_id", *[F.concat_ws(",", c).alias(c) for c in ("criterion_ids", "error_codes", "resource_kinds")])


ORACLES["failure_signatures"] = EVENTS + """
SELECT episode_id, coalesce(string_agg(DISTINCT goal_id, ',' ORDER BY goal_id) FILTER (kind = 'failed'), '') AS criterion_ids,
 array_to_string(list_sort(list_concat(list(DISTINCT 'DISK_ERROR_' || (event_id % 3)), CASE WHEN bool_or(kind = 'failed') THEN ['KeyError'] ELSE [] END)), ',') AS error_codes,
 coalesce(string_agg(DISTINCT resource, ',' ORDER BY resource), '') AS resource_kinds FROM episode_events GROUP BY episode_id"""


@query
def related_experiences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    kinds = lambda a, b: F.array(F.concat(F.lit(a), i % 3), F.concat(F.lit(b), i % 2))
    own = T.signature_score(kinds("c", "d"), F.array(F.lit("c1"), F.lit("d0")), kinds("e", "f"), F.array(F.lit("e2")), kinds("s", "t"), F.array(F.lit("s0"), F.lit("t1")), i % 5 == 0)
    x = d.select(i.alias("record_id"), T.terms(F.col("text")).alias("terms"), own.alias("signature_score"), (i % 2 == 0).alias("has_evidence"))
    return V.related(x, ["ha", "en", "erou", "que"], 20).select("record_id", "score", "has_evidence")


ORACLES["related_experiences"] = """SELECT record_id, score, record_id % 2 = 0 AS has_evidence FROM (SELECT doc_id AS record_id,
 CAST(len(list_filter(['ha','en','erou','que'], lambda q: list_contains(regexp_extract_all(lower(text), '[a-z0-9_]+'), q)))
  + 4 * (CAST(doc_id % 3 = 1 AS INTEGER) + CAST(doc_id % 2 = 0 AS INTEGER)) + 3 * CAST(doc_id % 3 = 2 AS INTEGER)
  + CAST(doc_id % 3 = 0 AS INTEGER) + CAST(doc_id % 2 = 1 AS INTEGER) + CAST(doc_id % 5 = 0 AS INTEGER) AS BIGINT) AS score FROM documents)
WHERE score > 0 ORDER BY score DESC, record_id % 2 = 0 DESC, record_id DESC LIMIT 20"""


@query
def obligation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return V.obligation_pairs(li.select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") % 10).alias("b"), (F.col("l_quantity") > 48).alias("required")), 60)


ORACLES["obligation_pairs"] = """WITH p AS (SELECT l_partkey AS a, l_suppkey % 10 AS b, bool_or(l_quantity > 48) AS required FROM lineitem GROUP BY ALL)
SELECT * FROM p WHERE required UNION ALL SELECT a, b, required FROM p WHERE NOT required QUALIFY row_number() OVER (ORDER BY a, b) <= greatest(0, 60 - (SELECT count(*) FROM p WHERE required))"""


@query
def goal_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("goal_id is not null").select("episode_id", "position", "goal_id")
    return V.tail(e, "episode_id", "position", 3)


ORACLES["goal_tail"] = EVENTS + "\nSELECT episode_id, position, goal_id FROM episode_events WHERE goal_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY episode_id ORDER BY position DESC) <= 3"


@query
def admissible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_partkey").alias("source"))
    barred = table(spark, sf_dir, "part").filter("p_partkey in (5, 11)").select(F.col("p_partkey").alias("node"))
    return V.admissible(sources, adapters.dependency_edges(spark, sf_dir), barred)


ORACLES["admissible_records"] = with_sql("dependency_edges", recursive=True) + """,
s AS (SELECT DISTINCT l_orderkey AS record, l_partkey AS source FROM lineitem),
r(root, node) AS (SELECT DISTINCT source, source FROM s UNION SELECT r.root, e.dst FROM r JOIN dependency_edges e ON r.node = e.src)
SELECT DISTINCT record FROM s WHERE record NOT IN (SELECT s.record FROM s JOIN r ON s.source = r.root WHERE r.node IN (SELECT p_partkey FROM part WHERE p_partkey IN (5, 11)))"""


@query
def newer_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    bindings = e.filter("position % 5 = 0").select("episode_id", (F.col("position") - 4).alias("anchor"), "position")
    return V.newer_boundary(bindings, e.filter("kind = 'user_message'"))


ORACLES["newer_boundaries"] = EVENTS + """
SELECT episode_id, position - 4 AS anchor, position FROM episode_events x WHERE position % 5 = 0
 AND EXISTS (SELECT 1 FROM episode_events u WHERE u.kind = 'user_message' AND u.episode_id = x.episode_id AND u.position > x.position - 4 AND u.position <= x.position)"""


def pages_of_tasks(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    tasks = n.select(F.col("n_nationkey").alias("task_id"), F.when(F.col("n_nationkey") % 2 == 0, "The").otherwise("une").alias("word"))
    links = n.select(F.col("n_nationkey").alias("task_id"), F.concat(F.lit("src"), F.col("n_regionkey")).alias("base"))
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("base"), F.col("doc_id").alias("path"), text.alias("text"))
    return V.reading_hits(tasks, links, pages, 2)


@query
def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of_tasks(spark, sf_dir, F.col("text"))


ORACLES["linked_pages"] = """SELECT n_nationkey AS task_id, source AS base, CAST(row_number() OVER (PARTITION BY n_nationkey, source ORDER BY doc_id) AS INTEGER) AS rank, doc_id AS path
FROM nation JOIN documents ON source = 'src' || n_regionkey WHERE contains(lower(text), CASE WHEN n_nationkey % 2 = 0 THEN 'the' ELSE 'une' END) QUALIFY rank <= 2"""
