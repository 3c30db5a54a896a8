"""Queries over runs, ledgers, event logs, histories and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import aggregates as A
from quarry.operators import events as E
from quarry.operators import graph, latest
from quarry.plans.registry import ORACLES, query
from quarry.sources import adapters
from quarry.sources.adapters import table, with_sql


@query
def rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rubric(adapters.rubric_proxies(spark, sf_dir), "criterion")


ORACLES["rubric"] = with_sql("rubric_proxies") + """
SELECT criterion, round(avg(score), 6) AS mean, count(*) AS proxies, CASE WHEN avg(score) >= 4 THEN 'accept' WHEN sum(n_evidence) > 0 THEN 'needs review' ELSE 'needs evidence' END AS recommendation
FROM rubric_proxies GROUP BY criterion"""


@query
def macro_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.macro_score(adapters.rubric_proxies(spark, sf_dir), "criterion")


ORACLES["macro_score"] = with_sql("rubric_proxies") + """
SELECT round(sum(m) / greatest(count(*), 1), 6) AS overall, count(*) AS criteria FROM (SELECT avg(score) AS m FROM rubric_proxies GROUP BY criterion)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.paired_outcomes(adapters.planned_requests(spark, sf_dir), adapters.request_results(spark, sf_dir))


SQL_PAIRED = with_sql("planned_requests", "request_results") + """,
j AS (SELECT p.*, r.outcome AS o, r.score AS s, r.terminal_status AS t, r.monetary_cost AS c,
 CASE WHEN r.request_id IS NULL THEN 'missing' WHEN r.binding <> p.binding THEN 'mismatched' ELSE 'observed' END AS state
 FROM planned_requests p LEFT JOIN request_results r ON p.request_id = r.request_id),
paired AS (SELECT request_id, case_id, split, arm, state, CASE WHEN state = 'observed' THEN o END AS outcome, CASE WHEN state = 'observed' THEN s END AS score,
 CASE WHEN state = 'observed' THEN t END AS terminal_status, CASE WHEN state = 'observed' THEN c END AS monetary_cost FROM j)"""


@query
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir)


ORACLES["paired_outcomes"] = SQL_PAIRED + "\nSELECT * FROM paired"

SQL_QUALITY = """count(*) AS n, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome IS NULL) AS unknown,
 round(count(*) FILTER (outcome = 'pass') / CAST(nullif(count(outcome), 0) AS DOUBLE), 6) AS success_rate, round(count(outcome) / CAST(count(*) AS DOUBLE), 6) AS coverage,
 round(count(*) FILTER (outcome = 'pass') / CAST(count(*) AS DOUBLE), 6) AS lower, round(count(*) FILTER (outcome IS NULL OR outcome = 'pass') / CAST(count(*) AS DOUBLE), 6) AS upper,
 CASE WHEN count(*) FILTER (outcome = 'pass') > 0 THEN true WHEN count(*) FILTER (outcome IS NULL) > 0 THEN NULL ELSE false END AS any_passed,
 CASE WHEN count(*) FILTER (outcome = 'fail') > 0 THEN false WHEN count(*) FILTER (outcome IS NULL) > 0 THEN NULL ELSE true END AS all_passed"""


@query
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.quality(paired(spark, sf_dir), "case_id")


ORACLES["quality"] = SQL_PAIRED + f"\nSELECT case_id, {SQL_QUALITY} FROM paired GROUP BY case_id"


@query
def mode_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.mode_groups(paired(spark, sf_dir), "case_id", "split")


ORACLES["mode_groups"] = SQL_PAIRED + f""",
g AS (SELECT split, case_id, {SQL_QUALITY} FROM paired GROUP BY split, case_id)
SELECT split, count(*) AS groups, count(*) FILTER (any_passed) AS any_passed_true, count(*) FILTER (NOT any_passed) AS any_passed_false, count(*) FILTER (any_passed IS NULL) AS any_passed_unknown,
 count(*) FILTER (all_passed) AS all_passed_true, count(*) FILTER (NOT all_passed) AS all_passed_false, count(*) FILTER (all_passed IS NULL) AS all_passed_unknown FROM g GROUP BY split"""


@query
def terminal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired(spark, sf_dir).groupBy("split", F.coalesce("terminal_status", F.lit("none")).alias("terminal_status")).agg(F.count("*").alias("runs"))


ORACLES["terminal_counts"] = SQL_PAIRED + "\nSELECT split, coalesce(terminal_status, 'none') AS terminal_status, count(*) AS runs FROM paired GROUP BY ALL"


@query
def criterion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    items = li.select("l_orderkey", F.col("l_linenumber").cast("double").alias("weight"), F.when(F.col("l_tax") > 0.02, F.col("l_discount") * 10).alias("score"))
    return A.criterion_scores(items, "l_orderkey", 0.5003)


ORACLES["criterion_scores"] = """WITH w AS (SELECT l_orderkey, sum(CAST(l_linenumber AS DOUBLE)) AS w, coalesce(sum(l_linenumber * l_discount * 10) FILTER (l_tax > 0.02), 0) AS s,
 coalesce(sum(l_linenumber) FILTER (l_tax <= 0.02), 0) AS m, count(*) AS expected, count(*) FILTER (l_tax > 0.02) AS known FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, expected, known, round(known / CAST(expected AS DOUBLE), 6) AS coverage, CASE WHEN known = expected THEN round(s / w, 6) END AS score,
 CASE WHEN known < expected THEN 'unknown' WHEN s / w >= 0.5003 THEN 'pass' ELSE 'fail' END AS outcome, round(s / w, 6) AS lower, round((s + m) / w, 6) AS upper FROM w"""


@query
def binary_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.binary_all(paired(spark, sf_dir), "case_id")


ORACLES["binary_all"] = SQL_PAIRED + """,
o AS (SELECT case_id, CASE WHEN count(*) FILTER (outcome = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (outcome IS NULL) = 0 THEN 'pass' ELSE 'unknown' END AS outcome FROM paired GROUP BY case_id)
SELECT case_id, outcome, CASE outcome WHEN 'fail' THEN CAST(0.0 AS DOUBLE) WHEN 'pass' THEN CAST(1.0 AS DOUBLE) END AS score, CASE WHEN outcome = 'pass' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS lower,
 CASE WHEN outcome = 'fail' THEN CAST(0.0 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS upper FROM o"""


@query
def requirement_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.requirement_status(paired(spark, sf_dir), "case_id")


ORACLES["requirement_status"] = SQL_PAIRED + """
SELECT case_id, CASE WHEN count(*) FILTER (outcome = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (outcome IS NULL) > 0 THEN 'unknown' ELSE 'pass' END AS status FROM paired GROUP BY case_id"""

SQL_TOTALS = """count(*) AS calls, count(*) FILTER (monetary_cost IS NULL OR currency IS NULL) AS missing_cost, count(DISTINCT currency) FILTER (monetary_cost IS NOT NULL) AS currencies,
 round(sum(monetary_cost) FILTER (currency IS NOT NULL), 2) AS known_cost,
 CASE WHEN count(*) FILTER (monetary_cost IS NULL OR currency IS NULL) = 0 AND count(DISTINCT currency) = 1 THEN round(sum(monetary_cost), 2) END AS complete_cost,
 CAST(sum(input_tokens) AS BIGINT) AS known_tokens, count(*) FILTER (input_tokens IS NULL) AS missing_tokens,
 CASE WHEN count(*) FILTER (input_tokens IS NULL) = 0 THEN CAST(sum(input_tokens) AS BIGINT) END AS complete_tokens"""


@query
def usage_by_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_totals(adapters.usage(spark, sf_dir), "stage")


ORACLES["usage_by_stage"] = with_sql("usage") + f"\nSELECT stage, {SQL_TOTALS} FROM (SELECT DISTINCT ON (usage_id) * FROM usage) GROUP BY stage"


@query
def usage_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.usage_totals(adapters.usage(spark, sf_dir), "key")


ORACLES["usage_by_key"] = with_sql("usage") + f"\nSELECT key, {SQL_TOTALS} FROM (SELECT DISTINCT ON (usage_id) * FROM usage) GROUP BY key"


@query
def usage_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = adapters.usage(spark, sf_dir)
    later = u.filter("key % 50 = 0").withColumn("stage", F.lit("Z"))
    return A.usage_conflicts(u.unionByName(later))


ORACLES["usage_conflicts"] = with_sql("usage") + "\nSELECT usage_id, 1 + count(DISTINCT concat_ws('|', stage, coalesce(CAST(monetary_cost AS VARCHAR), '-'), coalesce(currency, '-'), coalesce(CAST(input_tokens AS VARCHAR), '-'), key)) AS versions FROM usage WHERE key % 50 = 0 GROUP BY usage_id"


@query
def arm_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.arm_summaries(paired(spark, sf_dir), 2)
    return s.select("split", "case_id", *[F.round(c, 6).alias(c) for c in ("baseline_mean", "baseline_spread", "candidate_mean", "candidate_spread", "gain")])


SQL_ARMS = SQL_PAIRED + """,
g AS (SELECT split, case_id, arm, CASE WHEN count(*) = 2 AND count(score) = 2 THEN avg(score) END AS mean, CASE WHEN count(*) = 2 AND count(score) = 2 THEN max(score) - min(score) END AS spread FROM paired GROUP BY ALL),
arms AS (SELECT split, case_id, max(mean) FILTER (arm = 'baseline') AS baseline_mean, max(spread) FILTER (arm = 'baseline') AS baseline_spread,
 max(mean) FILTER (arm = 'candidate') AS candidate_mean, max(spread) FILTER (arm = 'candidate') AS candidate_spread,
 max(mean) FILTER (arm = 'candidate') - max(mean) FILTER (arm = 'baseline') AS gain FROM g GROUP BY split, case_id)"""
ORACLES["arm_summaries"] = SQL_ARMS + "\nSELECT split, case_id, round(baseline_mean, 6) AS baseline_mean, round(baseline_spread, 6) AS baseline_spread, round(candidate_mean, 6) AS candidate_mean, round(candidate_spread, 6) AS candidate_spread, round(gain, 6) AS gain FROM arms"


@query
def comparison_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.gates(A.arm_summaries(paired(spark, sf_dir), 2), 0.0, 0.9, 0.5)


ORACLES["comparison_gates"] = SQL_ARMS + """,
k AS (SELECT count(*) FILTER (gain IS NULL) AS incomplete, avg(gain) FILTER (split = 'target') AS tg, min(gain) FILTER (split = 'regression') AS r, min(gain) FILTER (split = 'transfer') AS t, max(greatest(baseline_spread, candidate_spread)) AS sp FROM arms)
SELECT incomplete, round(tg, 6) AS target_gain, tg > 0 AS target_gate, r >= -0.9 AS regression_gate, t >= -0.9 AS transfer_gate, sp <= 0.5 AS stability_gate,
 CASE WHEN incomplete > 0 OR tg IS NULL OR r IS NULL OR t IS NULL OR sp IS NULL THEN 'unknown' WHEN tg > 0 AND r >= -0.9 AND t >= -0.9 AND sp <= 0.5 THEN 'accepted' ELSE 'rejected' END AS decision FROM k"""


@query
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "supplier")
    rows = p.select(F.col("s_name").alias("digest"), F.floor(F.col("s_acctbal") / 1000).cast("long").alias("gain"), F.when(F.col("s_nationkey") % 4 > 0, F.col("s_nationkey")).alias("cost"))
    return A.rank_candidates(rows, "digest")


ORACLES["candidate_ranking"] = """SELECT s_name AS digest, CAST(floor(s_acctbal / 1000) AS BIGINT) AS gain, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey END AS cost,
 CAST(row_number() OVER (ORDER BY floor(s_acctbal / 1000) DESC, (CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey END) IS NULL, CASE WHEN s_nationkey % 4 > 0 THEN s_nationkey END, s_name) AS INTEGER) AS rank FROM supplier"""


@query
def call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.extra_calls(table(spark, sf_dir, "lineitem"), "l_orderkey")


ORACLES["call_budget"] = "SELECT count(*) AS planned, CAST(sum(greatest(c - 1, 0)) AS BIGINT) AS extra FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey)"


@query
def contrast_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro-average of the cases' gains by split; unknown while any case is incomplete."""
    s = A.arm_summaries(paired(spark, sf_dir), 2)
    return s.groupBy("split").agg(F.count("*").alias("cases"), F.count("gain").alias("complete"), F.round(F.when(F.count("*") == F.count("gain"), F.avg("gain")), 6).alias("effect"), F.round(F.avg("gain"), 6).alias("known_effect"))


ORACLES["contrast_effect"] = SQL_ARMS + "\nSELECT split, count(*) AS cases, count(gain) AS complete, CASE WHEN count(*) = count(gain) THEN round(avg(gain), 6) END AS effect, round(avg(gain), 6) AS known_effect FROM arms GROUP BY split"


@query
def latest_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.latest(adapters.revisions(spark, sf_dir), "memory_id", F.col("revision"))


ORACLES["latest_facts"] = with_sql("revisions") + "\nSELECT * FROM revisions QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1"


@query
def fact_chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.revisions(spark, sf_dir).filter("record_id % 11 <> 0")
    return latest.chain_breaks(r, "memory_id", "revision", "supersedes", "record_id").select("memory_id", "revision", "record_id")


ORACLES["fact_chain_breaks"] = with_sql("revisions") + """,
r AS (SELECT *, lag(record_id) OVER w AS prior, row_number() OVER w AS pos FROM revisions WHERE record_id % 11 <> 0 WINDOW w AS (PARTITION BY memory_id ORDER BY revision))
SELECT memory_id, revision, record_id FROM r WHERE prior IS DISTINCT FROM supersedes OR pos <> revision"""


@query
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("skills"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "skills")
    h = latest.history(o, "o_custkey", "o_orderkey", "skills")
    return h.select("o_custkey", "o_orderkey", F.concat_ws(",", "added").alias("added"), F.concat_ws(",", "removed").alias("removed"))


ORACLES["version_history"] = """WITH s AS (SELECT o_custkey, o_orderkey, list_sort(list(DISTINCT CAST(l_suppkey AS VARCHAR))) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
p AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), CAST([] AS VARCHAR[])) AS b FROM s)
SELECT o_custkey, o_orderkey, array_to_string(list_filter(k, lambda x: NOT list_contains(b, x)), ',') AS added, array_to_string(list_filter(b, lambda x: NOT list_contains(k, x)), ',') AS removed FROM p"""


@query
def insert_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_custkey", "o_orderpriority"), 256).alias("digest"))
    new = o.withColumn("digest", F.when(F.col("o_orderkey") % 10 == 0, F.lit("changed")).otherwise(F.col("digest")))
    return latest.insert_outcomes(o.filter("o_orderkey % 7 <> 0"), new, "o_orderkey", "digest").select("o_orderkey", "what")


ORACLES["insert_conflicts"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'insert' ELSE 'conflict' END AS what FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 10 = 0"


@query
def remaining_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.remaining(adapters.planned_requests(spark, sf_dir), adapters.request_results(spark, sf_dir), "request_id")


ORACLES["remaining_requests"] = with_sql("planned_requests") + "\nSELECT * FROM planned_requests WHERE request_id % 10 = 0"


@query
def plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned coordinates (nation, segment) that no customer covers; the grid is nations times five segments."""
    c = table(spark, sf_dir, "customer")
    segments = c.select("c_mktsegment").distinct().agg(F.collect_set("c_mktsegment").alias("s"))  # a handful of values
    grid = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1).alias("one")).join(segments.withColumn("one", F.lit(1)), "one").select("n_nationkey", F.explode("s").alias("c_mktsegment"))
    return grid.join(c.filter("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment").distinct(), ["n_nationkey", "c_mktsegment"], "left_anti")


ORACLES["plan_coverage"] = "SELECT n_nationkey, s AS c_mktsegment FROM nation, (SELECT DISTINCT c_mktsegment AS s FROM customer) EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_custkey % 3 = 0"


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of texts that are in more than one of three splits."""
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("digest"), (F.col("doc_id") % 3).alias("split"))
    return d.distinct().groupBy("digest").agg(F.count("*").alias("splits")).filter("splits > 1")


ORACLES["split_leakage"] = "SELECT sha256(text) AS digest, count(DISTINCT doc_id % 3) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.episode_events(spark, sf_dir)


EVENTS = with_sql("episode_events")


@query
def call_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.call_pairs(events(spark, sf_dir))


ORACLES["call_pairs"] = EVENTS + """,
g AS (SELECT episode_id, call_id, count(*) FILTER (kind = 'action') AS actions, count(*) FILTER (kind IN ('result','observation')) AS results FROM episode_events WHERE call_id IS NOT NULL GROUP BY ALL)
SELECT *, CASE WHEN actions = 1 AND results >= 1 THEN 'paired' ELSE 'ambiguous' END AS state FROM g"""


@query
def parent_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.parent_links(events(spark, sf_dir))


ORACLES["parent_links"] = EVENTS + """
SELECT c.event_id, c.parent_event_id, CASE WHEN p.event_id IS NULL THEN 'missing' WHEN p.episode_id <> c.episode_id THEN 'cross_episode' WHEN p.position >= c.position THEN 'out_of_order' ELSE 'linked' END AS state
FROM episode_events c LEFT JOIN episode_events p ON c.parent_event_id = p.event_id WHERE c.parent_event_id IS NOT NULL"""


@query
def resource_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.resource_links(events(spark, sf_dir))


ORACLES["resource_links"] = EVENTS + """
SELECT a.episode_id, a.resource, a.event_id AS first_id, b.event_id AS second_id, a.version_ref = b.version_ref AS version_match,
 CASE WHEN coalesce(b.parent_event_id = a.event_id, false) OR coalesce(a.parent_event_id = b.event_id, false) THEN 'declared_parent' ELSE 'same_resource_candidate' END AS relation
FROM episode_events a JOIN episode_events b ON a.episode_id = b.episode_id AND a.resource = b.resource AND a.position < b.position"""


@query
def goal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.goal_transitions(events(spark, sf_dir))


ORACLES["goal_transitions"] = EVENTS + """,
u AS (SELECT *, CASE WHEN goal_id IS NOT NULL AND task_revision IS NOT NULL THEN goal_id || '/' || task_revision END AS k FROM episode_events WHERE kind = 'user_message'),
l AS (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, min(position) OVER (PARTITION BY episode_id, k) AS f FROM u)
SELECT event_id, episode_id, position, CASE WHEN k IS NULL THEN 'ambiguous' WHEN p IS NULL OR p = k THEN 'continues' WHEN split_part(p, '/', 1) = goal_id THEN 'revises' WHEN f < position THEN 'resumes' ELSE 'switches' END AS transition FROM l"""

SQL_SEGMENTS = EVENTS + """,
n AS (SELECT *, CASE WHEN lag(goal_id) OVER w IS DISTINCT FROM goal_id THEN 1 ELSE 0 END AS fresh FROM episode_events WINDOW w AS (PARTITION BY episode_id ORDER BY position)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY position) AS run FROM n),
p AS (SELECT *, (row_number() OVER (PARTITION BY episode_id, run ORDER BY position) - 1) // 4 AS piece FROM r),
segments AS (SELECT episode_id, min(position) AS start, max(position) AS stop, count(*) AS events, max(goal_id) AS goal_id FROM p GROUP BY episode_id, run, piece)"""


@query
def goal_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.segments(events(spark, sf_dir), 4)


ORACLES["goal_segments"] = SQL_SEGMENTS + "\nSELECT * FROM segments"


@query
def segment_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.segment_priority(events(spark, sf_dir), 4, 3)


ORACLES["segment_priority"] = SQL_SEGMENTS + """,
q AS (SELECT s.episode_id, s.start, s.stop, CAST(min(CASE e.kind WHEN 'failed' THEN 0 WHEN 'user_message' THEN 1 WHEN 'result' THEN 2 WHEN 'observation' THEN 2 WHEN 'action' THEN 3 ELSE 5 END) AS INTEGER) AS priority
 FROM segments s JOIN episode_events e ON e.episode_id = s.episode_id AND e.position BETWEEN s.start AND s.stop GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY priority, start) AS INTEGER) AS rank FROM q QUALIFY rank <= 3"""


@query
def preceding_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.preceding_user(events(spark, sf_dir))


ORACLES["preceding_user"] = EVENTS + """,
u AS (SELECT *, last_value(CASE WHEN kind = 'user_message' THEN event_id END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_event_id FROM episode_events)
SELECT event_id, episode_id, user_event_id FROM u WHERE kind <> 'user_message'"""


@query
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    spans = li.select("l_orderkey", (F.col("l_partkey") % 500).alias("start"), (F.col("l_partkey") % 500 + F.col("l_quantity").cast("long")).alias("stop"))
    return E.interval_union(spans, "l_orderkey")


ORACLES["interval_union"] = """WITH s AS (SELECT l_orderkey, l_partkey % 500 AS a, l_partkey % 500 + CAST(trunc(l_quantity) AS BIGINT) AS b FROM lineitem),
r AS (SELECT *, max(b) OVER (PARTITION BY l_orderkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT l_orderkey, CAST(sum(greatest(b - greatest(a, coalesce(reach, a)), 0)) AS BIGINT) AS covered, CAST(sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) AS BIGINT) AS islands, min(a) AS first, max(b) AS last FROM r GROUP BY l_orderkey"""


@query
def chunk_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    reads = d.select("doc_id", (F.col("doc_id") % 700).alias("start"), F.octet_length("text").cast("long").alias("stop"))
    return E.overlapping_chunks(reads, 1024)


ORACLES["chunk_overlaps"] = """SELECT doc_id, start, stop, c AS chunk_no, greatest(start - c * 1024, 0) AS chunk_start, least(stop - c * 1024, 1024) AS chunk_stop
FROM (SELECT *, unnest(range(start // 1024, (stop - 1) // 1024 + 1)) AS c FROM (SELECT doc_id, doc_id % 700 AS start, CAST(strlen(text) AS BIGINT) AS stop FROM documents) WHERE stop > start)"""


@query
def event_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.spread(events(spark, sf_dir), 40)


#: Rounds in which halving picks the positions (from 0) of sequences of n.
HALVED = """
lengths AS (SELECT DISTINCT n FROM counted),
halves(n, lo, hi, depth) AS (SELECT n, CAST(1 AS BIGINT), n - 2, 2 FROM lengths UNION ALL
 SELECT n, CASE WHEN s = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN s = 0 THEN (lo + hi) // 2 - 1 ELSE hi END, depth + 1 FROM halves, (VALUES (0), (1)) v(s) WHERE lo <= hi),
rounds AS (SELECT n, (lo + hi) // 2 AS at, depth FROM halves WHERE lo <= hi UNION ALL SELECT n, 0, 0 FROM lengths UNION ALL SELECT n, n - 1, 1 FROM lengths WHERE n > 1)"""
ORACLES["event_spread"] = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
counted AS (SELECT episode_id, event_id, row_number() OVER (PARTITION BY episode_id ORDER BY position, event_id) - 1 AS at, count(*) OVER (PARTITION BY episode_id) AS n FROM episode_events),""" + HALVED + """
SELECT CAST(row_number() OVER (PARTITION BY episode_id ORDER BY depth, c.at) AS INTEGER) AS turn, episode_id, event_id FROM counted c JOIN rounds r ON c.n = r.n AND c.at = r.at ORDER BY turn, episode_id LIMIT 40"""


@query
def co_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).filter("resource is not null")
    return E.co_use(e, "episode_id", "resource")


ORACLES["co_use"] = EVENTS + """,
i AS (SELECT DISTINCT episode_id, resource FROM episode_events WHERE resource IS NOT NULL)
SELECT a.resource AS first, b.resource AS second, count(*) AS uses FROM i a JOIN i b ON a.episode_id = b.episode_id AND a.resource < b.resource GROUP BY ALL"""


@query
def conversation_user_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    e = c.select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("position"), F.col("turn").alias("event_id"), F.when(F.col("role") == "user", "user_message").otherwise(F.col("role")).alias("kind"))
    return E.preceding_user(e)


ORACLES["conversation_user_context"] = """SELECT turn AS event_id, conv_id AS episode_id, u AS user_event_id FROM (
 SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM conversations) WHERE role IS DISTINCT FROM 'user'"""


@query
def dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = adapters.dependency_edges(spark, sf_dir)
    roots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return graph.closure(edges, roots)


ORACLES["dependency_closure"] = with_sql("dependency_edges", recursive=True) + """,
r(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part
 UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN dependency_edges e ON r.node = e.src WHERE r.depth < 30)
SELECT root, node, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY ALL"""


@query
def dependency_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cyclic_nodes(adapters.dependency_edges(spark, sf_dir))


ORACLES["dependency_cycles"] = with_sql("dependency_edges", recursive=True) + """,
r(root, node, depth) AS (SELECT src, dst, 1 FROM dependency_edges UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN dependency_edges e ON r.node = e.src WHERE r.depth < 30)
SELECT root AS node, CAST(min(depth) AS INTEGER) AS length FROM r WHERE root = node GROUP BY root"""


@query
def duplicate_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + F.when(F.col("s_nationkey") % 2 == 0, 1).otherwise(3)).alias("dst")).filter("src % 5 <> 0")
    return graph.components(e)


ORACLES["duplicate_components"] = """WITH RECURSIVE e AS (SELECT s_suppkey AS a, s_suppkey + CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 3 END AS b FROM supplier WHERE s_suppkey % 5 <> 0),
b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(root, node) AS (SELECT a, a FROM b UNION SELECT r.root, b.b FROM r JOIN b ON r.node = b.a)
SELECT root AS node, min(node) AS label FROM r GROUP BY root"""
