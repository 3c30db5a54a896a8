"""Queries over stored records: admission, unions, completion, coverage and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import events as E
from quarry.operators import evidence as V
from quarry.operators import latest as L
from quarry.operators import records as S
from quarry.operators import reporting as R
from quarry.operators import selection as C
from quarry.plans.registry import ORACLES, query
from quarry.plans.runs import EVENTS, HALVED, events
from quarry.sources import adapters
from quarry.sources.adapters import AS_OF, table, with_sql


@query
def proposal_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", T.proposal_id(F.lit("expire"), F.col("url")).alias("proposal_id"), T.proposal_target(F.col("url")).alias("target"), T.budget_key(F.concat_ws("/", F.col("page_id") % 3, "url")).alias("budget"))


ORACLES["proposal_ids"] = """SELECT page_id, 'proposal:expire:' || left(translate(replace(to_base64(encode(url)), '=', ''), '+/', '-_'), 32) AS proposal_id,
 list_last(string_split(url, ':')) AS target, CAST(page_id % 3 AS VARCHAR) AS budget FROM pages"""


@query
def learning_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    space = F.when(i % 11 == 0, "feedback").when(i % 13 == 0, "requirement").otherwise("event")
    role = F.when(i % 7 == 0, "user").when(i % 2 == 0, "agent").otherwise("environment")
    kind = F.when(i % 17 == 0, "note").otherwise(F.col("kind"))
    return events(spark, sf_dir).select("event_id", T.learning_role(space, kind, role).alias("role"))


ORACLES["learning_roles"] = EVENTS + """
SELECT i AS event_id, CASE WHEN i % 11 = 0 THEN 'feedback' WHEN i % 13 = 0 OR i % 7 = 0 THEN 'user' WHEN i % 17 <> 0 AND kind = 'action' THEN 'action'
 WHEN i % 17 = 0 AND i % 2 = 0 THEN 'note' WHEN i % 17 <> 0 AND kind IN ('result','observation') THEN 'result' ELSE 'unknown' END AS role FROM (SELECT event_id AS i, kind FROM episode_events)"""


@query
def selection_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("failed", F.col("kind") == "failed").withColumn("kind", F.when(F.col("kind") == "user_message", "task").otherwise(F.col("kind")))
    return E.selection_units(e, e.filter("event_id % 997 = 0").select("event_id"))


ORACLES["selection_units"] = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
ranked AS (SELECT *, CASE WHEN event_id % 997 = 0 THEN -1 WHEN kind = 'user_message' OR position = max(position) OVER (PARTITION BY episode_id) THEN 0 WHEN kind = 'failed' THEN 1 ELSE 2 END AS p FROM episode_events),
units AS (SELECT episode_id, coalesce('c' || call_id, 'e' || event_id) AS unit, min(p) AS priority, min(position) AS position, count(*) AS members FROM ranked GROUP BY ALL),
counted AS (SELECT *, row_number() OVER (PARTITION BY priority, episode_id ORDER BY position, unit) - 1 AS at, count(*) OVER (PARTITION BY priority, episode_id) AS n FROM units),""" + HALVED + """
SELECT priority, CAST(row_number() OVER (PARTITION BY priority, episode_id ORDER BY depth, c.at) AS INTEGER) AS turn, episode_id, unit, position, members FROM counted c JOIN rounds r ON c.n = r.n AND c.at = r.at"""


@query
def call_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.call_metadata(events(spark, sf_dir), 60)


ORACLES["call_metadata"] = EVENTS.replace("WITH ", "WITH RECURSIVE ", 1) + """,
counted AS (SELECT episode_id, event_id, row_number() OVER (PARTITION BY episode_id ORDER BY position, event_id) - 1 AS at, count(*) OVER (PARTITION BY episode_id) AS n FROM episode_events),""" + HALVED + """,
chosen AS (SELECT event_id FROM (SELECT event_id, episode_id, row_number() OVER (PARTITION BY episode_id ORDER BY depth, c.at) AS turn FROM counted c JOIN rounds r ON c.n = r.n AND c.at = r.at) ORDER BY turn, episode_id LIMIT 60)
SELECT event_id FROM chosen UNION SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY episode_id, call_id ORDER BY position) AS r FROM episode_events
 WHERE call_id IS NOT NULL AND (episode_id, call_id) IN (SELECT (episode_id, call_id) FROM episode_events WHERE event_id IN (SELECT event_id FROM chosen) AND call_id IS NOT NULL)) WHERE r <= 2"""


@query
def captured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    o = d.select(F.col("doc_id").cast("string").alias("observation_id"), F.col("source").alias("project"), F.col("lang").alias("session"), F.lit("cli").alias("source"), F.concat(F.when(F.col("doc_id") % 3 == 0, "Session note: ").when(F.col("doc_id") % 3 == 1, "TEST ").otherwise(""), "text").alias("text"))
    return S.captured(o, AS_OF).withColumn("content", F.sha2("content", 256))


ORACLES["captured_items"] = f"""WITH x AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'Session note: ' WHEN 1 THEN 'TEST ' ELSE '' END || text AS c FROM documents),
k AS (SELECT *, CASE WHEN contains(t,'preference') OR contains(t,'prefrence') OR contains(t,'user') THEN 'personal' WHEN contains(t,'evidence') OR contains(t,'test') OR contains(t,'citation') THEN 'evidence'
 WHEN contains(t,'session') OR contains(t,'scratchpad') THEN 'session' ELSE 'project' END AS kind FROM (SELECT *, lower(c) AS t FROM x))
SELECT 'candidate:' || doc_id AS id, kind, source || ':' || lang AS scope, 'cli' AS source, CAST(0.5 AS DOUBLE) AS confidence, 'candidate' AS status, sha256(c) AS content, 0 AS retrieval_count,
 kind = 'evidence' AS cross_project_applicable, CASE WHEN kind = 'session' THEN TIMESTAMP '{AS_OF}' + INTERVAL 7 DAY END AS expires_at FROM k"""


@query
def record_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = S.public(table(spark, sf_dir, "nation").withColumn("private", F.lit("x")))
    return n.select("n_nationkey", S.record_digest("n_regionkey", "n_name", "n_nationkey").alias("digest"))


ORACLES["record_digests"] = """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS digest FROM nation"""


@query
def numbered_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    r = S.rules(d.select(F.col("doc_id").alias("skill_id"), F.lit(1).alias("revision"), F.split("text", "\n").alias("steps")))
    return r.withColumn("text", F.sha2("text", 256))


ORACLES["numbered_rules"] = """SELECT doc_id AS skill_id, 1 AS revision, 'R' || i AS rule_id, sha256(x[i]) AS text
 FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))"""


@query
def scope_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    i = F.col("p_partkey")
    require = F.when(i % 4 == 0, F.array(F.lit("Repair the"), F.lit("never"))).when(i % 4 == 1, F.array(F.lit("unseen")))
    k = p.select(i.alias("skill_id"), F.array(F.lower("p_brand")).alias("family"), F.when(i % 3 == 0, F.array(F.lit("repair"), F.lit("import"))).otherwise(F.array(F.lit("other"))).alias("triggers"), require.alias("require_any"), F.when(i % 7 == 0, F.array(F.lit("the import"))).alias("exclude_any"))
    return S.scope_selection(k, ["repair", "import", "brand#1"], "Repair  the IMPORT")


ORACLES["scope_selection"] = """WITH x AS (SELECT p_partkey AS i, CAST(lower(p_brand) = 'brand#1' AS INTEGER) AS f, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 0 END AS t, CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS r FROM part),
y AS (SELECT *, CASE WHEN i % 7 = 0 THEN 'scope_exclusion' WHEN i % 4 = 1 THEN 'scope_requirement' WHEN f + t + r = 0 THEN 'scope_or_trigger' END AS reason FROM x)
SELECT i AS skill_id, reason, CASE WHEN reason IS NULL THEN CAST(f + t + 2 * r AS DOUBLE) END AS score FROM y"""


@query
def group_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("task"), F.col("o_orderpriority").alias("executor"))
    runs = o.filter("run_id % 10 <> 0").withColumn("task", F.when(F.col("run_id") % 9 == 0, "X").otherwise(F.col("task")))
    return S.group_completion(o.filter("run_id % 17 <> 0"), runs, ["task", "executor"])


ORACLES["group_completion"] = """WITH x AS (SELECT o_custkey AS group_id, o_orderkey % 17 <> 0 AS p, o_orderkey % 10 <> 0 AS r, o_orderkey % 9 = 0 AS d FROM orders WHERE o_orderkey % 17 <> 0 OR o_orderkey % 10 <> 0),
y AS (SELECT group_id, count(*) FILTER (p) AS planned, count(*) FILTER (r) AS recorded, count(*) FILTER (NOT r) AS missing, count(*) FILTER (NOT p) AS unplanned, count(*) FILTER (p AND r AND d) AS differing FROM x GROUP BY group_id)
SELECT *, planned > 0 AND missing + unplanned + differing = 0 AS complete FROM y"""


@query
def scope_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = adapters.memory_items(spark, sf_dir).select("id", "kind", "scope")
    return S.union_by_id(m.filter("scope = 'src1'"), m.filter("kind = 'personal'").withColumn("scope", F.lit("personal")))


ORACLES["scope_union"] = with_sql("memory_items") + """
SELECT id, kind, scope FROM memory_items WHERE scope = 'src1' UNION ALL SELECT id, kind, 'personal' FROM memory_items WHERE kind = 'personal' AND scope <> 'src1'"""


@query
def resource_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return S.touching(e, e.filter("resource in ('f1', 'f3')").select("episode_id"), "episode_id").select("event_id", "episode_id")


ORACLES["resource_events"] = EVENTS + "\nSELECT event_id, episode_id FROM episode_events WHERE episode_id IN (SELECT episode_id FROM episode_events WHERE resource IN ('f1', 'f3'))"


@query
def state_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    made = e.withColumn("source_role", F.when(F.col("event_id") % 3 == 0, "agent").otherwise("environment")).withColumn("artifact", F.concat_ws("-", "episode_id", "event_id"))
    fb = e.filter("event_id % 4 = 0").select(F.col("event_id").alias("check_id"), "episode_id", F.sha2(F.concat_ws("-", "episode_id", F.col("event_id") + F.col("event_id") % 3), 256).alias("state_digest"), F.when(F.col("event_id") % 8 == 0, "bound").otherwise("unbound").alias("binding"))
    return S.state_resources(fb, made)


ORACLES["state_resources"] = EVENTS + """
SELECT f.event_id AS check_id, f.episode_id, 'evaluated-state:' || sha256(f.episode_id || '-' || (f.event_id + f.event_id % 3)) AS ref, e.event_id
FROM episode_events f LEFT JOIN episode_events e ON e.episode_id = f.episode_id AND e.event_id = f.event_id + f.event_id % 3 AND e.kind IN ('result','observation') AND e.event_id % 3 <> 0 WHERE f.event_id % 8 = 0"""


@query
def requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("requirement_id"))
    o = table(spark, sf_dir, "orders")
    results = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("check_id"), F.when(F.col("o_orderstatus") == "F", "fail").otherwise("pass").alias("outcome"))
    return S.requirement_coverage(c, o.select(F.col("o_custkey").alias("requirement_id"), F.col("o_orderkey").alias("check_id")), results)


ORACLES["requirement_coverage"] = """WITH x AS (SELECT c_custkey AS r, o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'fail' WHEN o_orderkey IS NOT NULL THEN 'pass' END AS o FROM customer LEFT JOIN orders ON c_custkey = o_custkey)
SELECT r AS requirement_id, count(k) AS checks, count(*) FILTER (o = 'pass') AS passed, count(*) FILTER (o = 'fail') AS failed,
 CASE WHEN count(*) FILTER (o = 'fail') > 0 THEN 'fail' WHEN count(k) > 0 AND count(*) FILTER (o = 'pass') = count(*) THEN 'pass' ELSE 'unknown' END AS status FROM x GROUP BY r"""


@query
def open_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("record_id"))
    return S.open_pairs(s, s.filter("record_id > 1").select(F.lit(1).cast("long").alias("a"), F.col("record_id").alias("b")).filter("b % 2 = 0"), 150)


ORACLES["open_pairs"] = "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey WHERE NOT (a.s_suppkey = 1 AND b.s_suppkey % 2 = 0) ORDER BY ALL LIMIT 150"


@query
def arm_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    i = F.col("c_custkey")
    scores = c.select(F.explode(F.array(*map(F.lit, ("frozen", "online", "batch")))).alias("arm"), i.alias("task_id"), (F.length("arm") * i % 100 / 100.0).alias("score"))
    scores = scores.filter("not (arm = 'batch' and task_id % 50 = 0)")
    return S.mean_gains(S.arm_differences(scores, c.select(i.alias("task_id")), "frozen"))


ORACLES["arm_gains"] = """WITH a AS (SELECT unnest(['online','batch']) AS arm), x AS (SELECT arm, c_custkey AS i, CASE WHEN NOT (arm = 'batch' AND c_custkey % 50 = 0) THEN length(arm) * c_custkey % 100 / CAST(100.0 AS DOUBLE) END - 6 * c_custkey % 100 / CAST(100.0 AS DOUBLE) AS g FROM customer, a)
SELECT arm, count(*) AS tasks, count(g) AS known, CASE WHEN count(g) = count(*) THEN round(avg(g), 6) END AS mean_gain FROM x GROUP BY arm"""


@query
def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    starts = o.select(i.alias("call_ref"), F.col("o_custkey").alias("stage"), (i % 1000).alias("input_chars"))
    back = o.filter("o_orderkey % 11 <> 0").select(i.alias("call_ref"), F.lit("ok").alias("status"), F.when(i % 7 != 0, i % 500 - 1).alias("tokens"))
    return S.ledger_summary(starts, back, "stage")


ORACLES["ledger_totals"] = """WITH x AS (SELECT o_custkey AS stage, o_orderkey % 1000 AS c, o_orderkey % 11 = 0 AS lost, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 500 > 0 THEN o_orderkey % 500 - 1 END AS t FROM orders)
SELECT stage, count(*) AS calls, CAST(sum(c) AS BIGINT) AS input_chars, count(*) FILTER (lost) AS unreturned, CAST(sum(t) AS BIGINT) AS known_tokens, count(*) - count(t) AS unknown_calls,
 CASE WHEN count(t) = count(*) THEN CAST(sum(t) AS BIGINT) END AS total_tokens FROM x GROUP BY stage"""


@query
def wall_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").filter("l_linenumber is not null")
    seq = F.struct("l_linenumber", "l_suppkey", "l_extendedprice")
    g = li.groupBy(F.col("l_orderkey").alias("run"), (F.col("l_partkey") % 3).alias("segment_id"), F.col("l_linenumber").alias("seq")).agg(F.min(seq).alias("x"))
    rows = g.select("run", "segment_id", "seq", F.when(F.col("seq") % 2 == 0, F.col("seq")).alias("finished_at"), F.when(F.col("x.l_suppkey") % 4 != 0, F.col("x.l_extendedprice")).alias("elapsed"))
    return S.wall_segments(rows, "run")


ORACLES["wall_segments"] = """WITH g AS (SELECT l_orderkey AS run, l_partkey % 3 AS seg, l_linenumber AS seq, min({'a': l_linenumber, 'b': l_suppkey, 'c': l_extendedprice}) AS x FROM lineitem GROUP BY ALL),
l AS (SELECT run, seg, seq % 2 = 0 AS f, CASE WHEN x.b % 4 <> 0 AND seq % 2 = 0 THEN x.c END AS s FROM g QUALIFY row_number() OVER (PARTITION BY run, seg ORDER BY seq % 2 = 0 DESC, CASE WHEN seq % 2 = 0 THEN -seq ELSE seq END) = 1)
SELECT run, count(*) AS segments, round(coalesce(sum(s), 0), 4) AS known_seconds, count(*) - count(s) AS missing, CASE WHEN count(s) = count(*) THEN round(coalesce(sum(s), 0), 4) END AS complete_seconds FROM l GROUP BY run"""


@query
def batch_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    starts = o.select(F.col("o_custkey").alias("batch"), i.alias("segment_id"), F.lit("started").alias("status"), F.col("o_orderdate").alias("at"), F.lit(None).cast("double").alias("elapsed"))
    ends = o.filter("o_orderkey % 6 <> 0").select(F.col("o_custkey").alias("batch"), i.alias("segment_id"), F.lit("done").alias("status"), F.col("o_orderdate").alias("at"), F.when(i % 5 != 0, F.col("o_totalprice")).alias("elapsed"))
    return S.batch_receipts(starts.union(ends), "batch", AS_OF)


ORACLES["batch_receipts"] = f"""WITH x AS (SELECT o_custkey AS batch, o_orderdate AS ts, CASE WHEN o_orderkey % 6 <> 0 AND o_orderkey % 5 <> 0 THEN o_totalprice END AS e FROM orders)
SELECT batch, count(*) AS segments, CAST(epoch(TIMESTAMP '{AS_OF}') - epoch(min(ts)) AS BIGINT) AS span_seconds, round(coalesce(sum(e), 0), 4) AS known_seconds, count(*) - count(e) AS missing FROM x GROUP BY batch"""


@query
def experience_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return S.experience_support(li.select(F.col("l_suppkey").alias("key"), F.col("l_orderkey").alias("episode_id"), F.when(F.col("l_partkey") % 5 != 0, F.col("l_partkey") % 40).alias("task_id"), (F.col("l_returnflag") == "A").alias("supports")))


ORACLES["experience_support"] = """WITH x AS (SELECT l_suppkey AS key, l_orderkey AS e, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 40 END AS t, l_returnflag = 'A' AS s FROM lineitem)
SELECT key, CAST(count(DISTINCT e) AS INTEGER) AS episodes, CAST(count(DISTINCT t) AS INTEGER) AS tasks, CAST(count(DISTINCT t) FILTER (s) AS INTEGER) AS support_tasks, CAST(count(DISTINCT e) FILTER (t IS NULL) AS INTEGER) AS unknown_episodes FROM x GROUP BY key"""


@query
def whole_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return S.whole_cost(li.select(F.col("l_orderkey").alias("actor"), F.when(F.col("l_discount") > 0, F.col("l_extendedprice")).alias("cost"), F.col("l_linestatus").alias("currency")), "actor")


ORACLES["whole_costs"] = """WITH x AS (SELECT l_orderkey AS actor, count(*) AS calls, count(*) FILTER (l_discount > 0) = count(*) AND count(l_linestatus) = count(*) AND count(DISTINCT l_linestatus) = 1 AS w, sum(l_extendedprice) AS c, min(l_linestatus) AS m FROM lineitem GROUP BY 1)
SELECT actor, calls, CASE WHEN w THEN round(c, 2) END AS cost, CASE WHEN w THEN m END AS currency FROM x"""


@query
def read_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select("event_id", F.lit(100).cast("long").alias("n_bytes"))
    parts = e.filter("event_id % 4 <> 0").select("event_id", F.explode(F.array(F.struct((i % 3 * 0).alias("start"), (40 + i % 2 * 20).alias("stop")), F.struct((40 + i % 3 * 10).alias("start"), F.lit(100).cast("long").alias("stop")))).alias("x"))
    return S.read_coverage(e, parts.select("event_id", "x.start", "x.stop"))


ORACLES["read_coverage"] = """WITH x AS (SELECT event_id % 4 <> 0 AS p, event_id % 4 <> 0 AND 40 + event_id % 2 * 20 >= 40 + event_id % 3 * 10 AS f FROM events)
SELECT count(*) AS total, count(*) FILTER (p) AS projected, count(*) FILTER (f) AS "full", count(*) FILTER (p AND NOT f) AS truncated, count(*) FILTER (NOT p) AS omitted, count(*) FILTER (f) = count(*) AS complete FROM x"""


@query
def cycle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return S.latest_cycles(o.select(F.col("o_custkey").alias("cycle_id"), F.col("o_orderkey").alias("seq"), F.when(F.col("o_orderkey") % 3 == 0, "applied").otherwise("planned").alias("status")))


ORACLES["cycle_records"] = """SELECT o_custkey AS cycle_id, CASE WHEN o_orderkey % 3 = 0 THEN 'applied' ELSE 'planned' END AS status, o_orderkey AS seq FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 = 0 DESC, CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END) = 1"""


@query
def knowledge_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    i = F.col("n_nationkey")
    bases = n.select(F.concat(F.lit("kb"), i % 7).alias("name"), F.col("n_name").alias("root"), i.alias("seq"), F.when(i % 2 == 0, F.array(F.lit("p1"))).alias("projects"))
    links = table(spark, sf_dir, "supplier").select(F.concat(F.lit("kb"), F.col("s_suppkey") % 9).alias("name"), F.concat(F.lit("p"), F.col("s_nationkey") % 4).alias("project"))
    return S.registry(bases, links).select("name", "root", F.concat_ws(",", "projects").alias("projects"))


ORACLES["knowledge_registry"] = """WITH b AS (SELECT 'kb' || (n_nationkey % 7) AS name, arg_max(n_name, n_nationkey) AS root, max(n_nationkey) AS k FROM nation GROUP BY 1),
l AS (SELECT DISTINCT 'kb' || (s_suppkey % 9) AS name, 'p' || (s_nationkey % 4) AS project FROM supplier), u AS (SELECT name, project FROM l UNION SELECT name, 'p1' FROM b WHERE k % 2 = 0)
SELECT b.name, root, coalesce(string_agg(project, ',' ORDER BY project), '') AS projects FROM b LEFT JOIN u ON b.name = u.name GROUP BY b.name, root"""


@query
def standing_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.revisions(spark, sf_dir)
    return S.standing(r.select(F.col("record_id").alias("assessment_id"), "supersedes", "memory_id")).select("assessment_id", "memory_id")


ORACLES["standing_assessments"] = with_sql("revisions") + "\nSELECT record_id AS assessment_id, memory_id FROM revisions QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1"


@query
def execution_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    pairs = p.filter("node % 5 = 0").select(F.col("node").alias("a"), (F.col("node") - 1).alias("b"))
    return S.execution_view(adapters.dependency_edges(spark, sf_dir), p.filter("node <> 3"), p.filter("node % 29 = 0"), p.filter("node % 58 = 7"), pairs)


ORACLES["execution_view"] = with_sql("dependency_edges", recursive=True) + """,
r(node) AS (SELECT p_partkey FROM part WHERE p_partkey % 29 = 0 OR p_partkey % 58 = 7 UNION SELECT e.dst FROM r JOIN dependency_edges e ON r.node = e.src),
i AS (SELECT src, dst FROM dependency_edges WHERE src IN (SELECT node FROM r)),
c(root, node) AS (SELECT src, dst FROM i UNION SELECT c.root, i.dst FROM c JOIN i ON c.node = i.src),
f AS (SELECT p_partkey AS a, p_partkey - 1 AS b FROM part WHERE p_partkey % 5 = 0 AND p_partkey IN (SELECT node FROM r) AND p_partkey - 1 IN (SELECT node FROM r))
SELECT node, CASE WHEN node % 29 = 0 THEN 'seed' WHEN node % 58 = 7 THEN 'background' ELSE 'dependency' END AS part,
 CASE WHEN node = 3 OR node NOT IN (SELECT p_partkey FROM part) THEN 'missing' WHEN node IN (SELECT root FROM c WHERE root = node) THEN 'cycle' WHEN node IN (SELECT a FROM f UNION SELECT b FROM f) THEN 'conflict' END AS problem FROM r"""


@query
def packet_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    p = li.groupBy(F.col("l_orderkey").alias("packet_id"), F.col("l_partkey").alias("ref_id")).agg(F.max("l_shipdate").cast("string").alias("excerpt"))
    return S.packet_union(p.withColumn("seq", F.col("packet_id")))


ORACLES["packet_union"] = """SELECT ref_id, packet_id, CAST(excerpt AS VARCHAR) AS excerpt FROM (SELECT l_orderkey AS packet_id, l_partkey AS ref_id, max(l_shipdate) AS excerpt FROM lineitem GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY packet_id) = 1"""


@query
def inventory_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("owner"), F.col("p_partkey").alias("path"), F.col("p_type").alias("digest"))
    return S.inventory_differences(p.filter("path % 13 <> 0"), p.filter("path % 11 <> 0").withColumn("digest", F.when(F.col("path") % 17 == 0, "changed").otherwise(F.col("digest"))))


ORACLES["inventory_differences"] = """WITH d AS (SELECT p_brand AS owner, p_partkey AS path, p_type AS digest FROM part WHERE p_partkey % 13 <> 0),
s AS (SELECT p_brand AS owner, p_partkey AS path, CASE WHEN p_partkey % 17 = 0 THEN 'changed' ELSE p_type END AS digest FROM part WHERE p_partkey % 11 <> 0)
SELECT *, 'declared' AS side FROM (SELECT * FROM d EXCEPT SELECT * FROM s) UNION ALL SELECT *, 'stored' FROM (SELECT * FROM s EXCEPT SELECT * FROM d)"""


@query
def effect_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("relation_id"), F.col("c_nationkey").alias("plan_id"), F.lit("O").alias("value"))
    o = table(spark, sf_dir, "orders").join(c.select("relation_id", "plan_id"), F.col("o_custkey") == F.col("relation_id")).select("relation_id", "plan_id", F.col("o_orderstatus").alias("value"))
    return S.effect_witnesses(c, o)


ORACLES["effect_witnesses"] = """WITH x AS (SELECT c_custkey AS relation_id, count(o_orderkey) AS witnesses FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O' GROUP BY 1)
SELECT relation_id, witnesses, CASE WHEN witnesses <> 1 THEN 'contrast_evidence' END AS reason FROM x"""


@query
def appended_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = adapters.revisions(spark, sf_dir)
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("memory_id"), (F.col("s_suppkey") + 10_000_000).alias("record_id"), F.col("s_name").alias("content"))
    return S.appended(r, new)


ORACLES["appended_facts"] = with_sql("revisions") + """,
n AS (SELECT s_suppkey % 40 AS m, s_suppkey + 10000000 AS r, s_name AS content, row_number() OVER (PARTITION BY s_suppkey % 40 ORDER BY s_suppkey) AS k FROM supplier),
l AS (SELECT memory_id, max(revision) AS v, arg_max(record_id, revision) AS last FROM revisions GROUP BY 1)
SELECT m AS memory_id, r AS record_id, content, coalesce(v, 0) + k AS revision, CASE WHEN k = 1 THEN last ELSE lag(r) OVER (PARTITION BY m ORDER BY k) END AS supersedes FROM n LEFT JOIN l ON m = memory_id"""


@query
def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.snapshots(table(spark, sf_dir, "part").select("p_brand", "p_size"), "p_brand", "p_size")


ORACLES["snapshot_ids"] = """SELECT DISTINCT sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS snapshot_id, p_brand, p_size FROM part"""


@query
def visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.visible_facts(adapters.revisions(spark, sf_dir).withColumn("project", F.concat(F.lit("p"), F.col("record_id") % 4)), "p1")


ORACLES["visible_facts"] = with_sql("revisions") + """
SELECT memory_id, record_id, kind FROM revisions WHERE kind = 'user' OR record_id % 4 = 1 QUALIFY row_number() OVER (PARTITION BY memory_id ORDER BY revision DESC) = 1"""


@query
def evaluated_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("proposal_id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("proposal_id"), F.col("o_orderkey").alias("at"), F.col("o_orderstatus").alias("decision"))
    return S.with_latest(c, o)


ORACLES["evaluated_proposals"] = "SELECT c_custkey AS proposal_id, arg_max(o_orderstatus, o_orderkey) AS decision, max(o_orderkey) AS evaluated_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1"


@query
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    i = F.col("page_id")
    url = F.concat(F.col("url"), F.lit(".md"))
    rows = p.select(i.alias("place"), F.when(i % 2 == 0, url).alias("path"), F.when(i % 3 == 0, url).alias("file"), F.when(i % 5 == 0, F.lit("Titled")).alias("title"), F.lit(None).cast("string").alias("excerpt"), F.when(i % 7 == 0, F.lit("  a \n b ")).alias("snippet"), F.col("url").alias("content"))
    return S.search_results(rows, 50)


ORACLES["search_results"] = """SELECT page_id AS place, p AS path, CASE WHEN page_id % 5 = 0 THEN 'Titled' ELSE regexp_replace(list_last(string_split(p, '/')), '\\.md$', '') END AS title,
 CASE WHEN page_id % 7 = 0 THEN 'a b' ELSE url END AS excerpt FROM (SELECT *, CASE WHEN page_id % 2 = 0 OR page_id % 3 = 0 THEN url || '.md' ELSE '' END AS p FROM pages ORDER BY page_id LIMIT 50)"""


@query
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))), lambda x: x["text"]).alias("asked"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == "system", F.struct("turn", "text")))), lambda x: x["text"]).alias("told"),
    )
    return S.session_summary(c.withColumn("source", F.col("conv_id").cast("string")), "source", Decisions="told", Open_Questions="asked").select("conv_id", F.sha2("summary", 256).alias("digest"))


ORACLES["session_summaries"] = """WITH c AS (SELECT conv_id, string_agg('- ' || text, chr(10) ORDER BY turn, text) FILTER (role = 'user') AS a, string_agg('- ' || text, chr(10) ORDER BY turn, text) FILTER (role = 'system') AS t FROM conversations GROUP BY 1)
SELECT conv_id, sha256(concat_ws(chr(10), '# Session Summary', '', '## Source', '', '- ' || conv_id, '', '## Decisions', '', coalesce(t, '- none'), '', '## Open Questions', '', coalesce(a, '- none'), '')) AS digest FROM c"""


@query
def shared_obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return S.obligations(li.select(F.col("l_suppkey").alias("snapshot"), F.col("l_partkey").alias("source"), F.col("l_linenumber").alias("place"), F.col("l_returnflag").alias("check"))).select("snapshot", "requirement_id")


ORACLES["shared_obligations"] = """SELECT DISTINCT l_suppkey AS snapshot, sha256('{"check":"' || l_returnflag || '","place":' || l_linenumber || ',"source":' || l_partkey || '}') AS requirement_id FROM lineitem"""


@query
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    reviews = o.select(F.col("o_orderkey").alias("relation_id"), F.when(F.col("o_orderkey") % 3 == 0, "applied").otherwise(F.col("o_orderstatus")).alias("status"))
    return S.review_counts(reviews, o.filter("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("relation_id"), F.when(F.col("o_orderkey") % 4 == 0, "REVOKE").otherwise("ADD").alias("op")))


ORACLES["review_counts"] = """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'applied' ELSE o_orderstatus END AS status, count(*) AS reviews, count(*) FILTER (o_orderkey % 3 = 0 AND o_orderkey % 4 = 0) AS revocations FROM orders GROUP BY 1"""


@query
def standing_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    r = o.select(F.col("o_custkey").alias("relation"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("review_id"), F.when(F.col("o_orderkey") % 3 == 0, "REVOKE").otherwise("APPLY").alias("op"))
    return L.active_relations(r).select("relation", "review_id")


ORACLES["standing_relations"] = """SELECT relation, review_id FROM (SELECT o_custkey AS relation, o_orderkey AS review_id FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) WHERE review_id % 3 <> 0"""


@query
def visible_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    f = table(spark, sf_dir, "events").select(i.alias("check_id"), F.when(i % 3 == 0, "adaptation").when(i % 3 == 1, "final").alias("visibility"))
    shown, gaps = V.visible(f)
    return shown.select("check_id", F.lit("shown").alias("state")).union(gaps)


ORACLES["visible_feedback"] = "SELECT event_id AS check_id, CASE WHEN event_id % 3 = 0 THEN 'shown' ELSE 'hidden_feedback' END AS state FROM events"


@query
def call_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"))
    back = o.filter("request_id % 5 <> 0").union(o.filter("request_id % 7 = 0"))
    return C.call_ledger(o, back)


ORACLES["call_states"] = """SELECT i AS request_id, n AS returns, CASE n WHEN 0 THEN 'open' WHEN 1 THEN 'returned' ELSE 'conflict' END AS state
FROM (SELECT o_orderkey AS i, CAST(o_orderkey % 5 <> 0 AS BIGINT) + CAST(o_orderkey % 7 = 0 AS BIGINT) AS n FROM orders)"""


@query
def progress_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as traces, their orders as checkpoints and cycles, lines as slots and supplied skills, events as reported use."""
    o, li, e = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "events"))
    i = F.col("o_orderkey")
    pick = lambda c, *values: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    manifests = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("trace_id"), (F.col("c_custkey") * 10).alias("byte_length"))
    checkpoints = o.select(F.col("o_custkey").alias("trace_id"), (i % 100).alias("next_raw_byte"), i.alias("created_at"), (i % 7).alias("event_count"), (i % 3 == 0).alias("index_complete"))
    bindings = o.select(pick(i, "bound", "ambiguous", "open").alias("status"), (i % 4).alias("resolved"))
    cycles = o.select(i.alias("cycle_id"), (i % 5).alias("signature_hits"), F.when(i % 6 != 0, i % 3).alias("range_reads"), (i * 2).alias("body_bytes"), F.when(i % 9 == 0, F.array(F.lit("analyzed"))).when(i % 9 == 1, F.array(F.lit("analyzed"), F.lit("failed"))).alias("segments"))
    diagnoses = o.select(F.when(i % 8 != 0, pick(i, "necessary", "unnecessary")).alias("verdict"))
    selected = li.select(F.col("l_orderkey").alias("manifest_id"), F.col("l_suppkey").cast("string").alias("skill_id"), F.lit("r1").alias("revision"))
    k = F.col("event_id")
    declared = F.array(F.struct(F.concat(F.lit("s"), k % 3).alias("skill_id"), pick(k, "read", "behavior", "seen").alias("level")), F.struct(F.lit("s9").alias("skill_id"), F.lit(None).cast("string").alias("level")))
    reported = e.select(k.alias("run_id"), (k % 4 - 1).cast("int").alias("place"), declared.alias("declared"))
    effects = e.select(pick(k, "known", "unknown").alias("status"))
    slots = li.select(pick(F.col("l_partkey"), "candidate", "error", "noop", "planned", "running").alias("status"))
    return R.together(R.memory_progress(manifests, checkpoints, bindings, cycles, diagnoses), R.consumption_layers(selected, reported, effects), R.proposal_attempts(slots))


ORACLES["progress_report"] = """WITH k AS (SELECT o_custkey AS t, arg_max(o_orderkey % 7, (o_orderkey % 100, o_orderkey)) AS n, arg_max(o_orderkey % 3 = 0, (o_orderkey % 100, o_orderkey)) AS done FROM orders GROUP BY o_custkey),
t AS (SELECT c_custkey * 10 AS b, n, coalesce(done, false) AS done FROM customer LEFT JOIN k ON t = c_custkey),
x AS (SELECT event_id % 3 AS s, event_id % 4 - 1 AS place FROM events WHERE event_id % 4 - 1 IN (0, 1)),
r(section, metric, key, value) AS (
 SELECT 'progress', unnest(['traces', 'archived_bytes', 'indexed_events', 'incomplete_traces']), NULL, unnest([count(*), sum(b), sum(n), count(*) FILTER (NOT done)]) FROM t
 UNION ALL SELECT 'progress', unnest(['derived_goal_bindings', 'signature_hits', 'range_reads', 'body_bytes']), NULL, unnest([sum(o_orderkey % 4), sum(o_orderkey % 5), sum(o_orderkey % 3) FILTER (o_orderkey % 6 <> 0), sum(o_orderkey * 2)]) FROM orders
 UNION ALL SELECT 'progress', 'goal_binding_status', ['bound', 'ambiguous', 'open'][o_orderkey % 3 + 1] AS y, count(*) FROM orders GROUP BY y
 UNION ALL SELECT 'progress', 'segment_status', unnest(['analyzed', 'failed']), unnest([count(*) FILTER (o_orderkey % 9 < 2), count(*) FILTER (o_orderkey % 9 = 1)]) FROM orders
 UNION ALL SELECT 'progress', 'necessity_verdict', CASE WHEN o_orderkey % 8 = 0 THEN 'legacy_unrecorded' WHEN o_orderkey % 2 = 0 THEN 'necessary' ELSE 'unnecessary' END AS y, count(*) FROM orders GROUP BY y
 UNION ALL SELECT 'consumption', 'provided_manifests', l_suppkey || '@r1', count(DISTINCT l_orderkey) FROM lineitem GROUP BY l_suppkey
 UNION ALL SELECT 'consumption', 'observed_level', CASE WHEN place = 1 OR s = 2 THEN 'unclassified' WHEN s = 0 THEN 'read' ELSE 'behavior' END AS y, count(*) FROM x GROUP BY y
 UNION ALL SELECT 'consumption', 'observed_skill', CASE WHEN place = 1 THEN 's9' ELSE 's' || s END AS y, count(*) FROM x GROUP BY y
 UNION ALL SELECT 'consumption', 'effect_status', CASE WHEN event_id % 2 = 0 THEN 'known' ELSE 'unknown' END AS y, count(*) FROM events GROUP BY y
 UNION ALL SELECT 'proposals', unnest(['planned_slots', 'finished_slots']), NULL, unnest([count(*), count(*) FILTER (l_partkey % 5 < 3)]) FROM lineitem
 UNION ALL SELECT 'proposals', 'slot_status', ['candidate', 'error', 'noop', 'planned', 'running'][l_partkey % 5 + 1] AS y, count(*) FROM lineitem GROUP BY y)
SELECT section, metric, key, CAST(value AS BIGINT) AS value FROM r"""
