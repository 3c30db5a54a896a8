"""Queries over what applies to a task, bounded packets, measurements and decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import context as X
from quarry.operators import events as E
from quarry.operators import measures as M
from quarry.operators import packets as P
from quarry.operators import selection
from quarry.plans.registry import ORACLES, query
from quarry.plans.runs import EVENTS, HALVED, SQL_PAIRED, events, paired
from quarry.sources import adapters
from quarry.sources.adapters import table, with_sql

RECURSIVE_EVENTS = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1)


@query
def relation_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    ends = [(i % 150 + 1).alias("from_id"), (F.col("o_custkey") % 150 + 1).alias("to_id")]
    r = o.select(
        i.alias("relation_id"), F.when(i % 19 == 0, "other").otherwise("p").alias("project_id"), F.when(i % 17 == 0, "co_retrieved").when(i % 2 == 0, "measured_effect").otherwise("co_used").alias("kind"),
        F.when(i % 13 == 0, 0).otherwise(1).alias("n_support"), F.when(i % 23 != 0, (i % 7) / 4.0).alias("value"), F.when(i % 10 == 0, "t2").when(i % 5 == 0, "t1").alias("task_scope"),
        F.when((i % 5).isin(1, 2), F.when(i % 3 == 0, "g").otherwise("f")).alias("family_scope"),
        F.when((i % 5).isin(2, 3), F.when(i % 4 == 0, F.array(F.lit("t9"))).otherwise(F.array(F.lit("t1"), F.lit("t3")))).alias("task_ids"),
        text("S", i % 6).alias("source_id"), *ends, i.alias("plan_id"),
    )
    nine, one = F.lit(9).cast("long"), F.lit(1).cast("long")
    r = r.withColumn("revisions", F.when(F.col("relation_id") % 29 == 0, F.create_map("from_id", nine))).withColumn("needed", F.when(F.col("relation_id") % 31 == 0, F.create_map("to_id", one)).otherwise(F.map_filter(F.create_map("to_id", one), lambda k, v: F.lit(False))))
    s, k = F.col("s"), F.col("p_partkey")
    skills = table(spark, sf_dir, "part").select(k, F.explode(F.array(*map(F.lit, range(4)))).alias("s")).filter(k % 11 != s)
    skills = skills.select(text("S", s).alias("snapshot_id"), k.alias("skill_id"), F.when(k % 5 == s, 2).otherwise(1).cast("long").alias("revision"))
    region = table(spark, sf_dir, "region")
    snapshots = region.select(text("S", F.col("r_regionkey")).alias("snapshot_id"), F.when(F.col("r_regionkey") == 4, "other").otherwise("p").alias("project_id"))
    plans = o.filter(i % 9 != 0).select(i.alias("plan_id"), text("h", i).alias("plan_hash"), F.when(i % 14 == 0, "SX").otherwise(text("S", i % 6)).alias("source_id"), *ends)
    results = o.filter(i % 4 == 0).union(o.filter(i % 12 == 0)).select(i.alias("plan_id"), text("h", i).alias("plan_hash"), i.alias("relation_id"), ((i % 7) / 4.0).alias("value"))
    published = snapshots.filter("snapshot_id in ('S0', 'S1')")
    return X.relation_applicability(r, snapshots, skills, plans, results, published, {"project": "p", "id": "t1", "family": "f", "snapshot": "S0"})


ORACLES["relation_applicability"] = """WITH skills AS (SELECT s, p_partkey AS k, CASE WHEN p_partkey % 5 = s THEN 2 ELSE 1 END AS rev FROM part, range(4) t(s) WHERE p_partkey % 11 <> s),
r AS (SELECT o_orderkey AS i, o_orderkey % 6 AS s, o_orderkey % 150 + 1 AS f, o_custkey % 150 + 1 AS t FROM orders),
j AS (SELECT r.*, a.rev AS frev, b.rev AS trev FROM r LEFT JOIN skills a ON a.s = r.s AND a.k = r.f LEFT JOIN skills b ON b.s = r.s AND b.k = r.t),
checks AS (SELECT i, s, f AS k, CASE WHEN i % 29 = 0 THEN 9 ELSE frev END AS w FROM j WHERE NOT (i % 31 = 0 AND f = t)
 UNION ALL SELECT i, s, t, trev FROM j WHERE i % 29 <> 0 AND i % 31 <> 0 UNION ALL SELECT i, s, t, 1 FROM j WHERE i % 31 = 0),
stale AS (SELECT i, count(*) FILTER (NOT coalesce(n.rev = w AND h.rev = w, false)) AS bad FROM checks c LEFT JOIN skills n ON n.s = 0 AND n.k = c.k LEFT JOIN skills h ON h.s = c.s AND h.k = c.k GROUP BY i),
x AS (SELECT i, CASE WHEN i % 19 = 0 OR i % 17 = 0 THEN 'relation_kind_or_project' WHEN i % 13 = 0 OR i % 23 = 0 THEN 'relation_evidence' WHEN i % 10 = 0 THEN 'task_scope'
 WHEN i % 5 IN (1, 2) AND i % 3 = 0 THEN 'task_family' WHEN i % 5 IN (2, 3) AND i % 4 = 0 THEN 'task_scope' WHEN i % 5 = 4 THEN 'unknown_scope' WHEN s = 5 THEN 'unverifiable_relation' WHEN s = 4 THEN 'source_project'
 WHEN frev IS NULL OR trev IS NULL THEN 'source_skill' WHEN i % 2 = 0 AND i % 9 = 0 THEN 'unverifiable_relation' WHEN i % 14 = 0 THEN 'contrast_binding'
 WHEN i % 2 = 0 AND (i % 4 <> 0 OR i % 12 = 0) THEN 'contrast_evidence' WHEN bad > 0 THEN 'skill_revision' WHEN s > 1 THEN 'unpublished_source' ELSE 'matching_scope_and_revisions' END AS reason FROM j LEFT JOIN stale USING (i))
SELECT i AS relation_id, reason = 'matching_scope_and_revisions' AS applicable, reason FROM x"""


@query
def resolved_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    text = lambda prefix, n: F.concat(F.lit(prefix), n.cast("string"))
    none, revision, digest = F.lit(None).cast("string"), text("r", i % 3), text("S", i % 2)
    reference = F.when(i % 4 == 0, text("att", i)).when(i % 4 == 1, text("run", i)).when(i % 4 == 2, text("exe", i)).otherwise(text("none", i))
    episodes = o.select(i.alias("episode_id"), reference.alias("reference"), F.lit("p").alias("project_id"), F.when(i % 5 != 0, revision).alias("task_revision"), digest.alias("snapshot_digest"))
    attempts = o.filter(i % 4 == 0).select(text("att", i).alias("attempt_id"), text("run", i).alias("run_id"), F.when(i % 28 == 0, "q").otherwise("p").alias("project_id"))
    runs = o.filter((i % 4 < 2) & (i % 10 != 1)).select(
        text("run", i).alias("run_id"), text("g", F.col("o_custkey")).alias("group_id"), text("exe", i).alias("raw_events_ref"), F.lit("p").alias("project_id"),
        F.when(i % 11 == 0, "rX").otherwise(revision).alias("task_revision"), digest.alias("snapshot_digest"))
    executions = o.filter(i % 3 != 0).select(text("exe", i).alias("execution_id"), F.lit("p").alias("project_id"), revision.alias("task_revision"), F.when(i % 13 == 0, "SX").otherwise(digest).alias("snapshot_digest"))
    planned = o.filter(i % 4 < 2)
    slots = planned.select(text("run", i).alias("run_id"), F.when(i % 37 == 0, "g0").otherwise(text("g", F.col("o_custkey"))).alias("group_id"))
    slots = slots.union(planned.filter(i % 41 == 0).select(text("run", i), F.lit("gZ")))
    c = F.col("c_custkey")
    groups = table(spark, sf_dir, "customer").select(text("g", c).alias("group_id"), text("b", c % 10).alias("batch_ref"), F.lit("p").alias("project_id"), none.alias("task_revision"), F.when(c % 17 == 0, "S0").alias("snapshot_digest"))
    n = F.col("n_nationkey")
    batches = table(spark, sf_dir, "nation").filter(n % 2 == 0).select(text("b", n).alias("batch_id"), F.when(n == 4, "q").otherwise("p").alias("project_id"), none.alias("snapshot_digest"))
    return X.resolved_sources(episodes, attempts, runs, executions, slots, groups, batches)


ORACLES["resolved_sources"] = """WITH o AS (SELECT o_orderkey AS i, o_custkey AS c FROM orders),
e AS (SELECT i, c, i % 4 < 2 AS named, i % 4 < 2 AND i % 10 <> 1 AS has_run, i % 3 <> 0 AND (i % 4 = 2 OR (i % 4 < 2 AND i % 10 <> 1)) AS has_exe FROM o),
g AS (SELECT *, CASE WHEN has_run THEN 'g' || c WHEN named AND i % 41 = 0 THEN least(CASE WHEN i % 37 = 0 THEN 'g0' ELSE 'g' || c END, 'gZ') WHEN named THEN CASE WHEN i % 37 = 0 THEN 'g0' ELSE 'g' || c END END AS group_id,
 CASE WHEN named THEN least(CASE WHEN i % 37 = 0 THEN 'g0' ELSE 'g' || c END, CASE WHEN i % 41 = 0 THEN 'gZ' END) END AS planned FROM e),
h AS (SELECT g.*, k.c_custkey, b.n_nationkey FROM g LEFT JOIN customer k ON group_id = 'g' || c_custkey LEFT JOIN nation b ON b.n_nationkey = c_custkey % 10 AND b.n_nationkey % 2 = 0),
v AS (SELECT *, named OR has_exe AS known, CASE WHEN has_run THEN CASE WHEN i % 11 = 0 THEN 'rX' ELSE 'r' || (i % 3) END END AS r1, CASE WHEN has_exe THEN 'r' || (i % 3) END AS r2,
 CASE WHEN has_run THEN 'S' || (i % 2) END AS s1, CASE WHEN has_exe THEN CASE WHEN i % 13 = 0 THEN 'SX' ELSE 'S' || (i % 2) END END AS s2, CASE WHEN c_custkey % 17 = 0 THEN 'S0' END AS s3,
 CASE WHEN i % 28 = 0 THEN 'q' END AS p1, CASE WHEN n_nationkey = 4 THEN 'q' END AS p2 FROM h)
SELECT i AS episode_id, known, CASE WHEN known THEN CASE i % 4 WHEN 2 THEN 'exe' ELSE 'run' END || i END AS run_id, group_id, coalesce(r1, r2) AS task_revision, coalesce(s1, s2, s3, CASE WHEN known THEN 'S' || (i % 2) END) AS snapshot_digest,
 CASE WHEN named AND i % 41 = 0 THEN 'run_group' WHEN has_run AND planned <> group_id THEN 'group_id' WHEN known AND (p1 = 'q' OR p2 = 'q') THEN 'project_id'
  WHEN len(list_distinct([CASE WHEN known AND i % 5 <> 0 THEN 'r' || (i % 3) END, r1, r2])) > 1 THEN 'task_revision'
  WHEN len(list_distinct([CASE WHEN known THEN 'S' || (i % 2) END, s1, s2, s3])) > 1 THEN 'snapshot_digest' END AS mismatch FROM v"""


@query
def skill_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    edges = adapters.dependency_edges(spark, sf_dir)
    return X.skill_context(edges, p.filter("node % 89 <> 0"), p, p.filter("node % 13 = 0").select(F.col("node").alias("a"), (2 * F.col("node") + 1).alias("b")))


ORACLES["skill_context"] = with_sql("dependency_edges", recursive=True) + """,
reach(root, node) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT root, dst FROM reach JOIN dependency_edges ON src = node),
cyc AS (SELECT DISTINCT root AS node FROM reach JOIN dependency_edges ON src = node AND dst = root),
blocked AS (SELECT DISTINCT root AS node FROM reach WHERE node IN (FROM cyc)),
levels AS (SELECT root AS node, CASE WHEN root NOT IN (FROM blocked) THEN CAST(count(*) - 1 AS INTEGER) END AS level FROM reach GROUP BY root),
clash AS (SELECT DISTINCT a.root FROM reach a JOIN reach b ON a.root = b.root AND b.node = 2 * a.node + 1 WHERE a.node % 13 = 0),
states AS (SELECT root, CASE WHEN bool_or(level IS NULL) THEN 'cycle' WHEN bool_or(node % 89 = 0) THEN 'missing' WHEN root IN (FROM clash) THEN 'conflict' ELSE 'ok' END AS state FROM reach JOIN levels USING (node) GROUP BY root)
SELECT root, node, CAST(row_number() OVER (PARTITION BY root ORDER BY level NULLS LAST, node) AS INTEGER) AS place, level, state FROM reach JOIN levels USING (node) JOIN states USING (root)"""


@query
def evidence_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("failed", F.col("kind") == "failed").withColumn("kind", F.when(F.col("kind") == "user_message", "task").otherwise(F.col("kind")))
    return P.evidence_packet(e.withColumn("text", F.concat_ws(" ", "kind", "goal_id", "resource", "version_ref")), e.filter("event_id % 997 = 0").select("event_id"), 30000, 20, 12)


ORACLES["evidence_packet"] = RECURSIVE_EVENTS + """,
ranked AS (SELECT *, coalesce('c' || call_id, 'e' || event_id) AS unit, concat_ws(' ', CASE WHEN kind = 'user_message' THEN 'task' ELSE kind END, goal_id, resource, version_ref) AS text,
 CASE WHEN event_id % 997 = 0 THEN -1 WHEN kind = 'user_message' OR position = max(position) OVER (PARTITION BY episode_id) THEN 0 WHEN kind = 'failed' THEN 1 ELSE 2 END AS p FROM episode_events),
units AS (SELECT episode_id, unit, min(p) AS priority, min(position) AS position FROM ranked GROUP BY ALL),
counted AS (SELECT *, row_number() OVER (PARTITION BY priority, episode_id ORDER BY position, unit) - 1 AS at, count(*) OVER (PARTITION BY priority, episode_id) AS n FROM units),""" + HALVED + """,
first AS (SELECT row_number() OVER (ORDER BY priority, turn, episode_id, unit) AS k, * FROM (SELECT priority, row_number() OVER (PARTITION BY priority, episode_id ORDER BY depth, c.at) AS turn, episode_id, unit
 FROM counted c JOIN rounds r ON c.n = r.n AND c.at = r.at) ORDER BY priority, turn, episode_id, unit LIMIT 105),
sums AS (SELECT k, first.episode_id, first.unit, CAST(sum(least(length(text), 12) + 350) AS BIGINT) AS whole, CAST(sum(CASE WHEN kind IN ('result','observation') THEN 0 ELSE least(length(text), 12) + 350 END) AS BIGINT) AS part,
 count(*) FILTER (kind = 'action') AS a, count(*) FILTER (kind IN ('result','observation')) AS r FROM first JOIN ranked USING (episode_id, unit) GROUP BY ALL),
one(k, used, named, state) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' UNION ALL
 SELECT s.k, used + CASE state2 WHEN 'given' THEN whole WHEN 'named' THEN part + 450 * r ELSE 0 END, named + CASE state2 WHEN 'named' THEN r ELSE 0 END, state2 FROM
 (SELECT s.*, used, named, CASE WHEN used + whole <= 22500 THEN 'given' WHEN a > 0 AND r > 0 AND named + r <= 20 AND used + part + 450 * r <= 22500 THEN 'named' ELSE 'omitted' END AS state2 FROM one JOIN sums s ON s.k = one.k + 1) s),
two(k, used, named, state) AS (SELECT CAST(0 AS BIGINT), max_by(used, k), max_by(named, k), '' FROM one UNION ALL
 SELECT k, used + CASE WHEN state2 = 'named' AND old = 'omitted' THEN part + 450 * r ELSE 0 END, named + CASE WHEN state2 = 'named' AND old = 'omitted' THEN r ELSE 0 END, state2 FROM
 (SELECT s.*, two.used, two.named, one.state AS old, CASE WHEN one.state <> 'omitted' THEN one.state WHEN a > 0 AND r > 0 AND two.named + r <= 20 AND two.used + part + 450 * r <= 30000 THEN 'named' ELSE 'omitted' END AS state2
  FROM two JOIN sums s ON s.k = two.k + 1 JOIN one ON one.k = s.k)),
told AS (SELECT s.episode_id, s.unit, event_id, CASE WHEN state = 'omitted' THEN 'omitted' WHEN state = 'named' AND kind IN ('result','observation') THEN 'locator' ELSE 'fragment' END AS part, text FROM two JOIN sums s USING (k) JOIN ranked r ON r.episode_id = s.episode_id AND r.unit = s.unit)
SELECT episode_id, unit, event_id, part, CASE WHEN part = 'fragment' THEN left(text, 12) END AS text FROM told"""


@query
def packet_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return P.visible_links(E.spread(e, 300).join(e.drop("episode_id"), "event_id"))


ORACLES["packet_links"] = RECURSIVE_EVENTS + """,
counted AS (SELECT episode_id, event_id, row_number() OVER (PARTITION BY episode_id ORDER BY position, event_id) - 1 AS at, count(*) OVER (PARTITION BY episode_id) AS n FROM episode_events),""" + HALVED + """,
seen AS (SELECT turn, e.* FROM (SELECT row_number() OVER (PARTITION BY episode_id ORDER BY depth, c.at) AS turn, episode_id, event_id FROM counted c JOIN rounds r ON c.n = r.n AND c.at = r.at ORDER BY turn, episode_id LIMIT 300) JOIN episode_events e USING (event_id))
SELECT a.event_id AS first_id, b.event_id AS second_id, a.resource, a.version_ref = b.version_ref AS version_match,
 CASE WHEN a.episode_id = b.episode_id AND coalesce(b.parent_event_id = a.event_id OR a.parent_event_id = b.event_id, b.parent_event_id = a.event_id, a.parent_event_id = b.event_id, false) THEN 'declared_parent' ELSE 'same_resource_candidate' END AS relation,
 CASE WHEN a.episode_id = b.episode_id THEN 'complete' ELSE 'partial' END AS coverage
FROM seen a JOIN seen b ON a.resource = b.resource AND (a.turn, a.episode_id, a.event_id) < (b.turn, b.episode_id, b.event_id) WHERE a.episode_id = b.episode_id OR a.version_ref = b.version_ref"""


@query
def text_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.locate("the", F.col("text"))
    return P.pieces(d, "text", F.when(at > 0, at - 1), 400, 2).select("doc_id", "place", "start_byte", "end_byte", F.sha2("piece", 256).alias("digest"))


ORACLES["text_pieces"] = """WITH d AS (SELECT doc_id, text, instr(text, 'the') - 1 AS a, length(text) AS n FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, 0 AS ord, greatest(a - 100, 0) AS s FROM d WHERE a >= 0 UNION ALL SELECT doc_id, 1, 0 FROM d UNION ALL SELECT doc_id, 2, greatest(n - 400, 0) FROM d
 UNION ALL SELECT doc_id, 2 + i, i * 400 FROM (SELECT doc_id, n, unnest(range(1, CAST(least(3, ceil(n / 400)) AS BIGINT))) AS i FROM d)),
o AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY min(ord)) - 1 AS place FROM s GROUP BY doc_id, s)
SELECT doc_id, CAST(place AS INTEGER) AS place, strlen(left(text, s)) AS start_byte, strlen(left(text, s)) + strlen(substr(text, s + 1, 400)) AS end_byte, sha256(substr(text, s + 1, 400)) AS digest FROM o JOIN d USING (doc_id)"""


@query
def maintenance_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("seq"), (F.col("doc_id") * 7919 % 900 + 20).alias("n_chars"))
    known = d.filter("record_id % 2 = 0").select(F.col("record_id").alias("a"), (F.col("record_id") + 1).alias("b"))
    chosen, pairs, omitted = P.maintenance_inputs(d, known, 12000, 40)
    none = F.lit(None).cast("long")
    return chosen.select(F.lit("chosen").alias("part"), F.col("record_id").alias("a"), none.alias("b")).union(pairs.select(F.lit("pair"), "a", "b")).union(omitted.select(F.lit("omitted"), "record_id", none))


ORACLES["maintenance_inputs"] = """WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, doc_id * 7919 % 900 + 21 AS size FROM documents),
f(k, doc_id, used, taken) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), false UNION ALL SELECT x.k, x.doc_id, used + CASE WHEN used + size <= 5999 THEN size ELSE 0 END, used + size <= 5999 FROM f JOIN x ON x.k = f.k + 1),
c AS (SELECT doc_id FROM f WHERE taken)
SELECT CASE WHEN taken THEN 'chosen' ELSE 'omitted' END AS part, doc_id AS a, CAST(NULL AS BIGINT) AS b FROM f WHERE k > 0
UNION ALL (SELECT 'pair', p.doc_id, q.doc_id FROM c p JOIN c q ON p.doc_id < q.doc_id WHERE NOT (p.doc_id % 2 = 0 AND q.doc_id = p.doc_id + 1) ORDER BY 2, 3 LIMIT 40)"""


@query
def related_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        i.alias("record_id"), F.when(i % 10 < 4, i - i % 10).alias("head"), F.array("lang", "source").alias("terms"), (i % 3).alias("signature_score"), (i % 2 == 0).alias("has_evidence"), (i * 7919 % 700).alias("n_chars"))
    return P.related_groups(d, ["en", "src1"], 30, 8000)


ORACLES["related_groups"] = """WITH RECURSIVE r AS (SELECT doc_id, CASE WHEN doc_id % 10 < 4 THEN doc_id - doc_id % 10 ELSE doc_id END AS head, CAST(coalesce(lang = 'en', false) AS BIGINT) + CAST(coalesce(source = 'src1', false) AS BIGINT) + doc_id % 3 AS score, doc_id % 2 AS e, doc_id * 7919 % 700 + 1 AS size FROM documents),
g AS (SELECT head, min((-score, e, doc_id)) FILTER (score > 0) AS place, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM r GROUP BY head),
x AS (SELECT *, row_number() OVER (ORDER BY place) AS k FROM g WHERE place IS NOT NULL AND n <= 30 AND size <= 7999),
f(k, head, n, size, taken) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false UNION ALL
 SELECT k, head, fn + CASE WHEN t THEN n ELSE 0 END, fs + CASE WHEN t THEN size ELSE 0 END, t FROM (SELECT x.*, f.n AS fn, f.size AS fs, f.n + x.n <= 30 AND f.size + x.size <= 7999 AS t FROM f JOIN x ON x.k = f.k + 1))
SELECT doc_id AS record_id, head, score FROM r WHERE head IN (SELECT head FROM f WHERE taken)"""


@query
def supplied_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    text = (
        F.when(i % 8 == 0, '{"tokens":{"input_tokens":5,"output_tokens":-1,"total_tokens":null},"monetary_cost":0.5,"currency":"EUR"}').when(i % 8 == 1, "[1]")
        .when(i % 8 == 2, '{"tokens":7,"monetary_cost":"x","currency":" "}').when(i % 8 == 4, '{"tokens":{"input_tokens":2.5,"output_tokens":true},"monetary_cost":3}').when(i % 8 == 5, "not json")
        .when(i % 8 == 6, F.concat(F.lit('{"tokens":{"input_tokens":'), i, F.lit('},"currency":"USD"}'))).when(i % 8 == 7, "null")
    )
    u = table(spark, sf_dir, "orders").select(i.alias("usage_id"), M.normalized_usage(text).alias("u")).select("usage_id", "u.*")
    return u.withColumn("diagnostics", F.array_join(F.transform("diagnostics", lambda d: d["path"]), ","))


ORACLES["supplied_usage"] = """SELECT o_orderkey AS usage_id, CASE o_orderkey % 8 WHEN 0 THEN 5 WHEN 6 THEN o_orderkey END AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, CAST(NULL AS BIGINT) AS total_tokens,
 CAST(CASE o_orderkey % 8 WHEN 0 THEN 0.5 WHEN 4 THEN 3 END AS DOUBLE) AS monetary_cost, CASE o_orderkey % 8 WHEN 0 THEN 'EUR' WHEN 6 THEN 'USD' END AS currency,
 CASE o_orderkey % 8 WHEN 0 THEN 'usage.tokens.output_tokens' WHEN 1 THEN 'usage' WHEN 2 THEN 'usage.tokens,usage.monetary_cost,usage.currency' WHEN 4 THEN 'usage.tokens.input_tokens,usage.tokens.output_tokens' WHEN 5 THEN 'usage' ELSE '' END AS diagnostics FROM orders"""


@query
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, odd = F.col("event_id"), F.length("event_type") % 2 == 1
    e = table(spark, sf_dir, "events").select(
        i.alias("measurement_id"), F.col("event_type").alias("stage"), F.when(i % 7 != 0, i % 100 / 4.0).alias("local_seconds"), F.when(~(odd & (i % 5 == 0)), i % 10 / 2.0).alias("monetary_cost"),
        F.lit("EUR").alias("currency"), F.when(i % 11 == 0, "error").otherwise("ok").alias("status"))
    return M.stage_totals(e.union(e.filter("measurement_id % 3 = 0")))


ORACLES["stage_totals"] = """WITH x AS (SELECT event_id AS i, event_type AS stage, CASE WHEN length(event_type) % 2 = 1 AND event_id % 5 = 0 THEN NULL ELSE event_id % 10 / CAST(2 AS DOUBLE) END AS c FROM events)
SELECT stage, count(*) AS measurements, round(coalesce(sum(i % 100 / CAST(4 AS DOUBLE)) FILTER (i % 7 <> 0), 0), 3) AS local_seconds, count(*) FILTER (i % 7 = 0) AS missing_time, count(*) - count(c) AS unpriced,
 count(*) FILTER (i % 11 = 0) AS errors, round(sum(c), 2) AS known_cost, CASE WHEN count(c) = count(*) THEN round(sum(c), 2) END AS complete_cost FROM x GROUP BY stage"""


@query
def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stage_id"), F.lit(0).cast("long").alias("start"), (100 + F.col("o_orderkey") % 50).alias("stop"))
    start = F.col("l_linenumber").cast("long") * 20
    calls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stage_id"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("stop"))
    return M.local_times(o, calls, 0.25)


ORACLES["local_times"] = """WITH d AS (SELECT l_orderkey AS k, CAST(sum(trunc(l_quantity)) AS BIGINT) AS d FROM lineitem GROUP BY 1),
x AS (SELECT o_orderkey AS stage_id, 100 + o_orderkey % 50 AS elapsed, coalesce(d, 0) AS delegated FROM orders LEFT JOIN d ON k = o_orderkey)
SELECT *, CASE WHEN delegated <= elapsed THEN elapsed - delegated END AS own, CASE WHEN delegated <= elapsed THEN round((elapsed - delegated) * CAST(0.25 AS DOUBLE), 6) END AS cost FROM x"""

GATES = ("complete_results", "target_gain", "regression_non_decrease", "call_budget", "scope_bound", "versions_unchanged", "transfer_gain", "transfer_non_decrease", "stability", "cost")


@query
def decision_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    plan = k % 40
    split = F.element_at(F.array(*map(F.lit, ("target", "regression", "transfer"))), (k % 3 + 1).cast("int"))
    cases = p.filter(~((plan % 8 == 0) & (k % 3 == 2))).select(plan.alias("plan_id"), split.alias("split"), F.when(k % 211 != 0, (k % 7 - 2 + plan % 5) / 10.0).alias("gain"), F.when(k % 503 != 0, k % 5 / 10.0).alias("spread"))
    verified = F.when(plan % 6 == 0, "pass").when(plan % 6 == 1, "unknown").when(plan % 6 == 2, "fail")
    plans = p.select(plan.alias("plan_id"), (plan * 10).alias("planned_calls"), (plan % 9 != 0).alias("unchanged"), F.when(plan % 7 != 0, plan / 2.0).alias("cost"), verified.alias("verified")).distinct()
    criteria = {
        "target_mean_gain_must_exceed": 0.23, "maximum_per_case_regression": 0.15, "maximum_evaluation_calls": 350, "transfer_claim": True, "transfer_mean_gain_must_exceed": 0.23,
        "maximum_per_case_transfer_regression": 0.15, "maximum_score_range": 0.5, "maximum_monetary_cost": 18.2,
    }
    return M.decision_gates(cases, plans, criteria, GATES)


ORACLES["decision_gates"] = """WITH c AS (SELECT p_partkey % 40 AS plan_id, p_partkey % 3 AS s, CASE WHEN p_partkey % 211 <> 0 THEN (p_partkey % 7 - 2 + p_partkey % 40 % 5) / CAST(10 AS DOUBLE) END AS g, CASE WHEN p_partkey % 503 <> 0 THEN p_partkey % 5 / CAST(10 AS DOUBLE) END AS r
 FROM part WHERE NOT (p_partkey % 40 % 8 = 0 AND p_partkey % 3 = 2)),
m AS (SELECT plan_id, count(*) = count(g) AS whole, count(*) = count(r) AS ranged, count(*) FILTER (s = 0) AS nt, count(*) FILTER (s = 1) AS nr, count(*) FILTER (s = 2) AS nx, avg(g) FILTER (s = 0) AS t, min(g) FILTER (s = 1) AS lo, avg(g) FILTER (s = 2) AS x, min(g) FILTER (s = 2) AS xlo, max(r) AS r FROM c GROUP BY plan_id),
q AS (SELECT p.p AS plan_id, coalesce(whole, false) AS w, m.* EXCLUDE (plan_id, whole) FROM (SELECT DISTINCT p_partkey % 40 AS p FROM part) p LEFT JOIN m ON m.plan_id = p.p),
g AS (SELECT plan_id, w, 'complete_results' AS gate, w AS passed FROM q UNION ALL SELECT plan_id, w, 'target_gain', CASE WHEN w THEN t > 0.23 END FROM q
 UNION ALL SELECT plan_id, w, 'regression_non_decrease', CASE WHEN w THEN coalesce(lo >= -0.15, true) END FROM q UNION ALL SELECT plan_id, w, 'call_budget', plan_id * 10 <= 350 FROM q
 UNION ALL SELECT plan_id, w, 'scope_bound', coalesce(nt, 0) > 0 AND coalesce(nr, 0) > 0 AND coalesce(nx, 0) > 0 FROM q UNION ALL SELECT plan_id, w, 'versions_unchanged', plan_id % 9 <> 0 FROM q
 UNION ALL SELECT plan_id, w, 'transfer_gain', CASE WHEN w AND nx > 0 THEN x > 0.23 END FROM q UNION ALL SELECT plan_id, w, 'transfer_non_decrease', CASE WHEN w AND nx > 0 THEN xlo >= -0.15 END FROM q
 UNION ALL SELECT plan_id, w, 'stability', CASE WHEN w AND ranged THEN r <= 0.5 END FROM q UNION ALL SELECT plan_id, w, 'cost', CASE WHEN plan_id % 7 <> 0 THEN plan_id / CAST(2 AS DOUBLE) <= 18.2 END FROM q
 UNION ALL SELECT plan_id, w, 'verification_complete', CASE plan_id % 6 WHEN 0 THEN true WHEN 2 THEN false END FROM q WHERE plan_id % 6 < 3)
SELECT plan_id, CASE WHEN NOT w OR bool_or(passed IS NULL) OVER (PARTITION BY plan_id) THEN 'unknown' WHEN bool_and(passed) OVER (PARTITION BY plan_id) THEN 'accepted' ELSE 'rejected' END AS status, gate, passed FROM g"""


@query
def bounded_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    field = F.element_at(F.array(*map(F.lit, ("criterion_ids", "error_codes", "resource_kinds", "symptom_terms", "evidence_refs"))), (i % 5 + 1).cast("int"))
    value = F.when(i % 5 == 0, F.concat(F.lit("c"), i % 23)).when(i % 5 == 1, F.concat(F.lit("E"), i % 31, F.lit("ERROR"))).when(i % 5 == 2, F.concat(F.lit("k"), i % 4)).when(i % 5 == 3, F.concat(F.lit("s"), i % 17)).otherwise(F.concat(F.lit("ev:"), i))
    return M.bounded_signature(events(spark, sf_dir).select("episode_id", F.col("position").alias("seq"), field.alias("field"), value.alias("value")), "episode_id", 160, 40)


ORACLES["bounded_signatures"] = RECURSIVE_EVENTS + """,
x AS (SELECT episode_id, position, ['criterion_ids','error_codes','resource_kinds','symptom_terms','evidence_refs'][event_id % 5 + 1] AS field,
 CASE event_id % 5 WHEN 0 THEN 'c' || (event_id % 23) WHEN 1 THEN 'E' || (event_id % 31) || 'ERROR' WHEN 2 THEN 'k' || (event_id % 4) WHEN 3 THEN 's' || (event_id % 17) ELSE 'ev:' || event_id END AS value FROM episode_events),
f AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq) AS nth FROM (SELECT episode_id, field, value, min(position) AS seq, count(*) AS n FROM x GROUP BY ALL)),
fold(episode_id, nth, size, kept, feats, evid) AS (SELECT DISTINCT episode_id, CAST(0 AS BIGINT), CAST(40 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM f UNION ALL
 SELECT episode_id, nth, CASE WHEN size + cost <= 160 THEN size + cost ELSE size END, CASE WHEN size + cost <= 160 THEN list_append(kept, field || '|' || value) ELSE kept END,
  feats + CASE WHEN size + cost > 160 AND field <> 'evidence_refs' THEN n ELSE 0 END, evid + CASE WHEN size + cost > 160 AND field = 'evidence_refs' THEN n ELSE 0 END
 FROM (SELECT f.*, d.size, d.kept, d.feats, d.evid, length(value) + 2 + CASE WHEN len(list_filter(d.kept, lambda k: starts_with(k, f.field || '|'))) > 0 THEN 1 ELSE 0 END AS cost FROM fold d JOIN f ON f.episode_id = d.episode_id AND f.nth = d.nth + 1)),
z AS (SELECT episode_id, max_by(kept, nth) AS kept, max_by(feats, nth) AS feats, max_by(evid, nth) AS evid FROM fold GROUP BY episode_id)
SELECT episode_id, """ + ", ".join(f"list_sort(list_transform(list_filter(kept, lambda k: starts_with(k, '{f}|')), lambda k: split_part(k, '|', 2))) AS {f}" for f in ("criterion_ids", "error_codes", "resource_kinds", "symptom_terms", "evidence_refs")) + """,
 feats AS omitted_features, evid AS omitted_evidence, feats = 0 AND evid = 0 AS complete FROM z"""


@query
def known_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, i = adapters.request_results(spark, sf_dir), F.col("request_id")
    status = F.when(i % 7 != 0, F.when(i % 5 == 0, "error").otherwise("ok"))
    return r.select("request_id", M.known_criterion(F.col("binding") != "X", status, F.col("outcome"), F.col("score") * 1.2, i % 3).alias("known"))


ORACLES["known_criteria"] = with_sql("request_results") + """
SELECT request_id, coalesce(binding <> 'X' AND request_id % 7 <> 0 AND request_id % 5 <> 0 AND outcome IS NOT NULL AND score * CAST(1.2 AS DOUBLE) BETWEEN 0 AND 1 AND request_id % 3 > 0, false) AS known FROM request_results"""


@query
def slot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    slots = o.select(i.alias("run_id"), F.col("o_custkey").alias("group_id"), F.col("o_orderstatus").alias("snapshot"), F.when(i % 4 > 0, F.col("o_orderpriority")).alias("task_revision"))
    runs = slots.filter("run_id % 10 <> 0").withColumn("snapshot", F.when(F.col("run_id") % 9 == 0, "X").otherwise(F.col("snapshot"))).withColumn("execution_status", F.when(F.col("run_id") % 3 == 0, "timeout").otherwise("completed"))
    return M.slot_states(slots, runs, ["snapshot", "task_revision"])


ORACLES["slot_states"] = """SELECT o_custkey AS group_id, o_orderkey AS run_id, state, CASE WHEN state = 'bound' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'timeout' ELSE 'completed' END ELSE 'unknown' END AS execution_status
FROM (SELECT *, CASE WHEN o_orderkey % 10 = 0 THEN 'missing' WHEN o_orderkey % 9 = 0 THEN 'contradictory' ELSE 'bound' END AS state FROM orders)"""


@query
def binding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, i = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("o_orderkey")
    plans = c.select(F.col("c_custkey").alias("plan_id"), F.col("c_mktsegment").alias("base"), F.col("c_nationkey").alias("protocol"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("cases"))
    v = o.select(F.col("o_custkey").alias("plan_id"), i.alias("validation_id"), F.col("o_orderstatus").alias("status")).join(plans, "plan_id")
    wrong = lambda n, col: F.when(F.col("validation_id") % n == 0, F.lit(None)).otherwise(F.col(col)).alias(col)
    return M.binding_errors(plans, v.select("plan_id", "validation_id", "status", wrong(7, "base"), wrong(3, "protocol"), wrong(11, "cases")), "plan_id", ["base", "protocol", "cases"])


ORACLES["binding_errors"] = """SELECT c_custkey AS plan_id, o_orderkey AS validation_id, o_orderstatus AS status,
 list_filter([CASE WHEN o_orderkey % 7 = 0 THEN 'base' END, CASE WHEN o_orderkey % 3 = 0 THEN 'protocol' END, CASE WHEN o_orderkey % 11 = 0 AND c_custkey % 5 > 0 THEN 'cases' END], lambda x: x IS NOT NULL) AS errors FROM orders JOIN customer ON o_custkey = c_custkey"""


@query
def reference_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    return M.reference_violations(("order_customer", o, "o_orderkey", "o_custkey", c.filter("c_custkey % 10 <> 0"), "c_custkey"), ("customer_nation", c, "c_custkey", "c_nationkey", n.filter("n_nationkey <> 7"), "n_nationkey"))


ORACLES["reference_violations"] = """SELECT 'order_customer' AS "check", CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS reference FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)
UNION ALL SELECT 'customer_nation', CAST(c_custkey AS VARCHAR), '7' FROM customer WHERE c_nationkey = 7"""


@query
def import_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, i = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(F.when(i % 500 != 0, i).alias("id"), F.col("o_orderstatus").alias("digest")).union(o.filter(i % 13 == 0).select(i, F.when(i % 2 == 0, "X").otherwise(F.col("o_orderstatus"))).filter("o_orderkey % 500 <> 0"))
    return M.import_problems(rows, o.filter(i % 3 == 0).select(i.alias("id"), F.when(i % 7 == 0, "Y").otherwise(F.col("o_orderstatus")).alias("digest")), "id", "digest")


ORACLES["import_problems"] = """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 26 = 0 THEN 'several_contents' ELSE 'conflicts_with_stored' END AS problem FROM orders WHERE o_orderkey % 500 <> 0 AND (o_orderkey % 26 = 0 OR o_orderkey % 21 = 0)
UNION ALL SELECT NULL, 'missing_id' FROM orders HAVING count(*) FILTER (o_orderkey % 500 = 0) > 0"""


@query
def update_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("task"))
    return M.update_batches(o, "project", "task", "frozen_microbatch", 4)


ORACLES["update_batches"] = """SELECT o_custkey AS project, o_orderkey AS task, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS batch, 'frozen_microbatch' AS update_mode, true AS learns FROM orders"""


@query
def report_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, o, u = paired(spark, sf_dir), table(spark, sf_dir, "orders"), adapters.usage(spark, sf_dir).dropDuplicates(["usage_id"])
    known, n = F.count("outcome"), F.count("*")
    return M.report(
        evaluation=(p, {"planned": n, "known": known, "passed": F.count_if(F.col("outcome") == "pass"), "coverage": F.try_divide(known, n), "unaccounted": F.count_if(F.col("state") != "observed"), "cases": F.count_distinct("case_id")}),
        usage=(u, {"calls": n, "unpriced": F.count_if(F.col("monetary_cost").isNull()), "complete_tokens": F.when(F.count("input_tokens") == n, F.sum("input_tokens"))}),
        tasks=(o, {"episodes": n, "distinct_tasks": F.count_distinct("o_custkey"), "accepted": F.count_if(F.col("o_orderstatus") == "F")}),
    )


ORACLES["report_figures"] = SQL_PAIRED + """,
e AS (SELECT count(*) AS planned, count(outcome) AS known, count(*) FILTER (outcome = 'pass') AS passed, count(outcome) / count(*) AS coverage, count(*) FILTER (state <> 'observed') AS unaccounted, count(DISTINCT case_id) AS cases FROM paired),
x AS (SELECT DISTINCT ON (id) * FROM (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice) AS BIGINT)) AS id, l_discount, l_tax, l_quantity FROM lineitem)),
u AS (SELECT count(*) AS calls, count(*) FILTER (l_discount = 0) AS unpriced, CASE WHEN count(*) FILTER (l_tax = 0) = 0 THEN sum(trunc(l_quantity)) END AS complete_tokens FROM x),
t AS (SELECT count(*) AS episodes, count(DISTINCT o_custkey) AS distinct_tasks, count(*) FILTER (o_orderstatus = 'F') AS accepted FROM orders)
""" + "\nUNION ALL ".join(f"SELECT '{s}' AS section, '{m}' AS metric, round(CAST({m} AS DOUBLE), 6) AS value FROM {f}" for s, f, ms in (
    ("evaluation", "e", ("planned", "known", "passed", "coverage", "unaccounted", "cases")), ("usage", "u", ("calls", "unpriced", "complete_tokens")), ("tasks", "t", ("episodes", "distinct_tasks", "accepted"))) for m in ms)


@query
def scope_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.scope_phrases(F.col("text"), F.array(*map(F.lit, ("The", "of   the", "data", "zzz")))).alias("phrases"))


ORACLES["scope_phrases"] = r"""SELECT doc_id, list_filter([CASE WHEN contains(t, 'the') THEN 'The' END, CASE WHEN contains(t, 'data') THEN 'data' END, CASE WHEN contains(t, 'of the') THEN 'of   the' END, CASE WHEN contains(t, 'zzz') THEN 'zzz' END], lambda x: x IS NOT NULL) AS phrases
FROM (SELECT doc_id, regexp_replace(lower(text), '[ \t\n\v\f\r]+', ' ', 'g') AS t FROM documents)"""


@query
def signature_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    pick = lambda prefix, *n: F.array(*[F.concat(F.lit(prefix), i % m) for m in n])
    fixed = lambda *v: F.array(*map(F.lit, v))
    return table(spark, sf_dir, "events").select("event_id", T.signature_score(pick("c", 3, 4), fixed("c1", "c2"), pick("e", 5, 6), fixed("e0"), pick("s", 7), fixed("s3", "s4"), i % 2 == 0).cast("long").alias("score"))


ORACLES["signature_scores"] = """SELECT event_id, CAST(4 * len(list_intersect(list_distinct(['c' || (event_id % 3), 'c' || (event_id % 4)]), ['c1','c2'])) + 3 * len(list_intersect(list_distinct(['e' || (event_id % 5), 'e' || (event_id % 6)]), ['e0']))
 + len(list_intersect(['s' || (event_id % 7)], ['s3','s4'])) + CAST(event_id % 2 = 0 AS INTEGER) AS BIGINT) AS score FROM events"""


def skill_library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as skills of a task for each 20 keys; some need the next one, some conflict with the third one on, and pairs are related."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 20).cast("string").alias("task_id"), (F.col("p_partkey") % 20).alias("m"), (F.col("p_size") * 3 + 50).cast("long").alias("chars"), (F.col("p_size") % 7).cast("double").alias("base"))
    k = F.col("k")
    name = lambda c: F.lpad(c.cast("string"), 9, "0")
    skill = F.struct(name(k).alias("skill_id"), F.col("chars"), F.when(k % 5 == 0, F.array(name(k + 3))).otherwise(F.array().cast("array<string>")).alias("conflicts"))
    one = p.select("task_id", "k", "m", "base", skill.alias("skill"))
    following = one.select((k - 1).alias("k"), "task_id", F.col("skill").alias("next"))
    j = one.join(following, ["task_id", "k"], "left")
    closure = F.array_compact(F.array("skill", F.when(k % 4 == 0, F.col("next"))))
    related = p.filter("m + 2 < 20").select(
        "task_id", name(k).alias("from"), name(k + 2).alias("to"), F.element_at(F.array(*map(F.lit, ("co_used", "measured_effect", "observed"))), (k % 3 + 1).cast("int")).alias("kind"),
        ((k % 9 - 2) / 2).alias("value"), F.when(k % 6 == 0, F.array(name(k + 1))).otherwise(F.array().cast("array<string>")).alias("background"), (k % 4 != 1).alias("supported"))
    return j.select("task_id", name(k).alias("skill_id"), "base", closure.alias("closure")), related


@query
def skill_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.select_roots(*skill_library(spark, sf_dir), weight=0.5, max_roots=5, budget=700)


#: Each step takes the open skill of the best score; what it needs comes in with it, or it is left out.
ORACLES["skill_roots"] = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey // 20 AS t, p_partkey % 20 AS m, p_size * 3 + 50 AS chars, CAST(p_size % 7 AS DOUBLE) AS base FROM part),
c AS (SELECT p.*, CASE WHEN p.k % 4 = 0 AND n.k IS NOT NULL THEN [p.k, n.k] ELSE [p.k] END AS needs FROM p LEFT JOIN p n ON n.k = p.k + 1 AND n.t = p.t),
r AS (SELECT t, k AS a, k + 2 AS b, (k % 9 - 2) / 2 AS v, CASE WHEN k % 6 = 0 THEN [k + 1] ELSE [] END AS bg FROM p WHERE m + 2 < 20 AND k % 4 <> 1 AND k % 3 < 2),
s AS (SELECT t, a AS k, b AS other, v, bg FROM r UNION ALL SELECT t, b, a, v, bg FROM r WHERE a % 3 = 0),
f(t, step, held, opened, roots, k, score, verdict) AS (
 SELECT t, 0, CAST([] AS BIGINT[]), list(k), 0, CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM p GROUP BY t
 UNION ALL SELECT t, step + 1, CASE WHEN verdict = 'root' THEN list_distinct(list_concat(held, needs)) ELSE held END, list_filter(opened, lambda x: x <> k), roots + CASE WHEN verdict = 'root' THEN 1 ELSE 0 END, k, score, verdict
 FROM (SELECT *, CASE WHEN list_contains(held, k) THEN 'held' WHEN len(list_filter(whole, lambda x: x % 5 = 0 AND list_contains(whole, x + 3))) > 0 THEN 'declared_conflict'
   WHEN (SELECT sum(p.chars) + count(*) - 1 FROM p WHERE list_contains(whole, p.k)) > 700 THEN 'budget' ELSE 'root' END AS verdict
  FROM (SELECT f.t, f.step, f.held, f.opened, f.roots, c.k, c.needs, list_distinct(list_concat(f.held, c.needs)) AS whole,
    c.base + 0.5 * coalesce(sum(s.v) FILTER (WHERE list_contains(f.held, s.other) AND list_has_all(list_concat(f.held, c.needs), s.bg)), 0) AS score
   FROM f JOIN c ON c.t = f.t AND list_contains(f.opened, c.k) LEFT JOIN s ON s.t = f.t AND s.k = c.k WHERE f.roots < 5 GROUP BY f.t, f.step, f.held, f.opened, f.roots, c.k, c.needs, c.base)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY score DESC, k) = 1)),
l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY t ORDER BY step DESC) = 1),
g AS (SELECT l.t, c.k, c.base + 0.5 * coalesce(sum(s.v) FILTER (WHERE list_contains(l.held, s.other) AND list_has_all(list_concat(l.held, c.needs), s.bg)), 0) AS score
 FROM l JOIN c ON c.t = l.t AND list_contains(l.opened, c.k) AND NOT list_contains(l.held, c.k) LEFT JOIN s ON s.t = l.t AND s.k = c.k GROUP BY l.t, c.k, c.base),
u AS (SELECT t, step AS o, k, score, verdict FROM f WHERE verdict <> 'held' UNION ALL SELECT t, 1000 + k, k, score, 'root_limit' FROM g)
SELECT CAST(t AS VARCHAR) AS task_id, CAST(row_number() OVER (PARTITION BY t ORDER BY o) AS INTEGER) AS place, lpad(CAST(k AS VARCHAR), 9, '0') AS skill_id, CAST(score AS DOUBLE) AS score, verdict FROM u"""
