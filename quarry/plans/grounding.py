"""Queries over grounding: duplicates folded around conflicts, ways into cycles, admission with reasons, citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import admission, checks, citations, folding, graph
from quarry.plans.registry import ORACLES, query
from quarry.sources import adapters
from quarry.sources.adapters import table, with_sql


@query
def folded_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of 40 an owner, with suggested duplicates and conflicts between near keys."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.floor(F.col("o_orderkey") / 40).cast("string").alias("owner"), (F.col("o_orderkey") % 40).alias("m"))
    turn = (F.col("i") * 7919 % 10007).cast("int")
    link = lambda step, every, to: o.filter(f"m % {every} = 0 and m + {step} < 40").select("owner", turn.alias("position"), F.lit("LINK_DUPLICATE").alias("kind"), F.col("i").alias("a"), (F.col("i") + step).alias("b"), (F.col("i") + to).alias("preferred"))
    mark = o.filter("m % 7 = 0 and m + 3 < 40").select("owner", turn.alias("position"), F.lit("MARK_CONFLICT").alias("kind"), F.col("i").alias("a"), (F.col("i") + 3).alias("b"), F.lit(None).cast("long").alias("preferred"))
    return folding.fold_groups(link(1, 3, 0).unionByName(link(2, 5, 2)).unionByName(mark))


#: The fold goes link by link over each owner's list of (record, head) pairs.
ORACLES["folded_duplicates"] = """WITH RECURSIVE o AS (SELECT o_orderkey AS i, CAST(o_orderkey // 40 AS VARCHAR) AS owner, o_orderkey % 40 AS m, o_orderkey * 7919 % 10007 AS turn FROM orders),
l AS (SELECT owner, turn, i AS a, i + 1 AS b, i AS p FROM o WHERE m % 3 = 0 AND m + 1 < 40 UNION ALL SELECT owner, turn, i, i + 2, i + 2 FROM o WHERE m % 5 = 0 AND m + 2 < 40),
k AS (SELECT owner, i AS a, i + 3 AS b FROM o WHERE m % 7 = 0 AND m + 3 < 40),
n AS (SELECT DISTINCT owner, unnest([a, b]) AS x FROM (SELECT owner, a, b FROM l UNION ALL FROM k)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY turn, a, b, p) AS step FROM l),
mk AS (SELECT owner, list([a, b]) AS marks FROM k GROUP BY owner),
f(owner, step, heads) AS (SELECT owner, CAST(0 AS BIGINT), map(list(x ORDER BY x), list(x ORDER BY x)) FROM n GROUP BY owner
 UNION ALL SELECT f.owner, s.step, CASE WHEN len(list_filter(coalesce(marks, []), lambda z: f.heads[z[1]] IN (f.heads[s.a], f.heads[s.b]) AND f.heads[z[2]] IN (f.heads[s.a], f.heads[s.b]))) > 0 THEN f.heads
  ELSE map(map_keys(f.heads), list_transform(map_values(f.heads), lambda h: CASE WHEN h IN (f.heads[s.a], f.heads[s.b]) THEN f.heads[s.p] ELSE h END)) END
  FROM f JOIN ordered s ON s.owner = f.owner AND s.step = f.step + 1 LEFT JOIN mk ON mk.owner = f.owner),
z AS (SELECT owner, unnest(map_entries(heads)) AS e FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY step DESC) = 1),
h AS (SELECT owner, e.key AS member, e.value AS head FROM z),
c AS (SELECT DISTINCT k.owner, x.head AS u, y.head AS v FROM k JOIN h x ON x.member = k.a JOIN h y ON y.member = k.b WHERE x.head <> y.head),
g AS (SELECT owner, u, v FROM c UNION SELECT owner, v, u FROM c),
r(owner, u, v) AS (SELECT owner, u, u FROM g UNION SELECT r.owner, r.u, g.v FROM r JOIN g ON g.owner = r.owner AND g.u = r.v),
w AS (SELECT owner, u, string_agg(CAST(v AS VARCHAR), ',' ORDER BY v) AS conflict FROM r GROUP BY owner, u)
SELECT h.owner, member, head, conflict FROM h LEFT JOIN w ON w.owner = h.owner AND w.u = h.head"""


def placed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that refer to the half of their key, to one that does not exist, and some back to their double and on."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    half = p.filter("src > 1").select("src", F.lit(1).alias("place"), F.floor(F.col("src") / 2).cast("long").alias("dst"))
    gone = p.filter("src % 4 = 0").select("src", F.lit(0).alias("place"), (-F.col("src")).alias("dst"))
    back = p.filter("src % 61 = 0").select("src", F.lit(2).alias("place"), (F.col("src") + 1).alias("dst"))
    there = p.filter("src % 97 = 0").select(F.floor(F.col("src") / 2).cast("long").alias("src"), F.lit(0).alias("place"), F.col("src").alias("dst"))
    return half.unionByName(gone).unionByName(back).unionByName(there)


@query
def circular_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    ways = graph.cycle_paths(placed_references(spark, sf_dir), items)
    return ways.select("node", F.concat(F.lit("circular_reference:"), F.array_join(F.col("path").cast("array<string>"), "->")).alias("marker"))


#: All ways from each item; the first by places among those that meet an item again.
ORACLES["circular_references"] = """WITH RECURSIVE e AS (
 SELECT p_partkey AS src, 1 AS place, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION ALL SELECT p_partkey, 0, -p_partkey FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT p_partkey, 2, p_partkey + 1 FROM part WHERE p_partkey % 61 = 0 UNION ALL SELECT p_partkey // 2, 0, p_partkey FROM part WHERE p_partkey % 97 = 0),
f AS (SELECT * FROM e WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)),
r(node, way, places, met) AS (SELECT p_partkey, [p_partkey], CAST([] AS INTEGER[]), false FROM part
 UNION ALL SELECT r.node, list_append(way, f.dst), list_append(places, f.place), list_contains(way, f.dst) FROM r JOIN f ON f.src = way[-1] WHERE NOT met)
SELECT node, 'circular_reference:' || array_to_string(arg_min(way, places), '->') AS marker FROM r WHERE met GROUP BY node"""


@query
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong_components(placed_references(spark, sf_dir))


ORACLES["strong_components"] = """WITH RECURSIVE e AS (
 SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, -p_partkey FROM part WHERE p_partkey % 4 = 0
 UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 61 = 0 UNION SELECT p_partkey // 2, p_partkey FROM part WHERE p_partkey % 97 = 0),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"""


@query
def learning_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes: their customer's older order is the parent, their key the reference that the rules look up."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_id"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("d"))
    i = F.col("episode_id")
    episodes = o.select("episode_id", F.when(i % 31 == 0, "rejected_target_evaluation").otherwise("execution").alias("source_kind"), i.alias("reference"))
    of = lambda rule, *columns: o.filter(rule).select(i.alias("reference"), *columns)
    executions = of("episode_id % 3 = 0", F.when(i % 33 != 0, i).alias("run_id"), F.when(i % 39 != 0, F.floor(i / 10).cast("long")).alias("group_id"))
    g = o.select(F.floor(i / 10).cast("long").alias("group_id")).distinct()
    j = F.col("group_id")
    groups = g.filter("group_id % 41 <> 0").select("group_id", F.when(j % 2 == 0, "frozen_microbatch").otherwise("task_barrier").alias("update_mode"), F.floor(j / 6).cast("long").alias("batch_id"), F.lit(3).alias("planned"), F.when(j % 23 == 0, 2).otherwise(3).alias("recorded"))
    batches = g.filter("group_id % 2 = 0 and floor(group_id / 6) % 29 <> 0").select(F.when(j % 46 == 0, F.floor(j / 6) + 1).otherwise(F.floor(j / 6)).cast("long").alias("batch_id"), "group_id")
    reasons = admission.own_reasons(episodes, of("episode_id % 62 = 0"), of("episode_id % 101 = 0"), of("episode_id % 53 = 0", F.when(i % 2 == 0, "execute").otherwise("plan").alias("stage")), executions, groups, batches)
    p = o.alias("x").join(o.select("c", F.col("d").alias("pd"), F.col("episode_id").alias("parent_id")), "c").filter("pd < d and parent_id % 5 = 0 and episode_id % 2 = 0").select("episode_id", "parent_id")
    return admission.rejections(reasons, p)


ORACLES["learning_rejections"] = """WITH RECURSIVE o AS (SELECT o_orderkey AS i, o_custkey AS c, o_orderdate AS d FROM orders),
g AS (SELECT DISTINCT i // 10 AS j FROM o), gr AS (SELECT j, j % 2 = 0 AS frozen, j // 6 AS b, j % 23 <> 0 AS closed FROM g WHERE j % 41 <> 0),
ba AS (SELECT CASE WHEN j % 46 = 0 THEN j // 6 + 1 ELSE j // 6 END AS b, j FROM g WHERE j % 2 = 0 AND (j // 6) % 29 <> 0),
st AS (SELECT ba.b, bool_and(coalesce(gr.b = ba.b AND frozen, false)) AS whole, bool_and(coalesce(closed, false)) AS closed, list(ba.j) AS members FROM ba LEFT JOIN gr USING (j) GROUP BY ba.b),
x AS (SELECT i, i % 33 <> 0 AS run, CASE WHEN i % 39 <> 0 THEN i // 10 END AS j FROM o WHERE i % 3 = 0 AND i % 31 <> 0),
y AS (SELECT x.*, gr.b, frozen, gr.closed, st.whole, st.closed AS all_closed, st.members FROM x LEFT JOIN gr USING (j) LEFT JOIN st ON frozen AND st.b = gr.b),
own AS (SELECT i, 1 AS r FROM o WHERE i % 31 = 0 AND i % 62 <> 0 UNION ALL SELECT i, 2 FROM o WHERE i % 31 <> 0 AND i % 101 = 0 UNION ALL SELECT i, 3 FROM o WHERE i % 31 <> 0 AND i % 106 = 0
 UNION ALL SELECT i, CASE WHEN NOT run THEN 4 WHEN j IS NULL OR b IS NULL THEN 5 WHEN frozen AND members IS NULL THEN 6 WHEN frozen AND NOT (whole AND list_contains(members, j)) THEN 7 WHEN NOT closed OR (frozen AND NOT all_closed) THEN 8 END FROM y),
first AS (SELECT i, min(r) AS r FROM own WHERE r IS NOT NULL GROUP BY i),
p AS (SELECT a.i, b.i AS parent FROM o a JOIN o b ON a.c = b.c AND b.d < a.d AND b.i % 5 = 0 AND a.i % 2 = 0),
w(i, r) AS (SELECT i, r FROM first UNION SELECT p.i, w.r FROM w JOIN p ON p.parent = w.i),
m AS (SELECT i, min(r) AS r FROM w GROUP BY i)
SELECT m.i AS episode_id, ['not_authorized','selection_material','relabelled_return','no_terminal_run','no_group_plan','batch_unknown','batch_contradicts','group_not_closed'][m.r] AS reason, coalesce(f.r > m.r, true) AS inherited
FROM m LEFT JOIN first f USING (i)"""


def drafts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A draft for each order, with claims from its lines; some lists are none, some drafts cannot be read."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft_id"), F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s"), F.concat(F.lit("r"), "l_partkey").alias("r"), "l_partkey", "l_suppkey")
    next_p = F.concat(F.lit("p"), F.col("l_partkey") + 1)
    claim = F.struct(F.array("p", "s").alias("evidence_refs"), F.struct(F.array(next_p).alias("counterevidence_refs"), F.col("n").alias("n")).alias("notes"))
    rows = li.groupBy("draft_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p", "s", claim.alias("c"), "r"))), lambda x: F.struct(x["c"].alias("c"), F.struct(x["r"].alias("ref_id")).alias("q"))).alias("x"))
    odd = F.when(F.col("draft_id") % 3 == 0, F.lit("none")).otherwise(F.lit("p1"))
    body = F.to_json(F.struct(F.struct(F.transform("x", lambda y: y["c"]).alias("claims"), odd.alias("boundary_refs")).alias("summary"), F.transform("x", lambda y: y["q"]).alias("read_requests")))
    made = rows.select("draft_id", F.when(F.col("draft_id") % 97 == 0, F.substring(body, 1, 20)).otherwise(body).alias("draft"))
    provided = li.filter("n % 3 <> 0").select("draft_id", F.col("p").alias("ref_id")).unionByName(li.filter("n % 2 = 0").select("draft_id", F.col("s").alias("ref_id"))).unionByName(li.filter("l_partkey % 10 = 0").select("draft_id", F.col("r").alias("ref_id")))
    return made, provided, li.filter("n % 4 <> 0").select("draft_id", F.col("r").alias("ref_id"))


@query
def citation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return citations.citation_errors(*drafts(spark, sf_dir))


ORACLES["citation_errors"] = """WITH l AS (SELECT l_orderkey AS draft_id, l_linenumber AS n, 'p' || l_partkey AS p, 's' || l_suppkey AS s, 'r' || l_partkey AS r, l_partkey,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey, 's' || l_suppkey) - 1 AS i FROM lineitem),
provided AS (SELECT draft_id, p AS ref_id FROM l WHERE n % 3 <> 0 UNION SELECT draft_id, s FROM l WHERE n % 2 = 0 UNION SELECT draft_id, r FROM l WHERE l_partkey % 10 = 0),
readable AS (SELECT draft_id, r AS ref_id FROM l WHERE n % 4 <> 0),
c AS (SELECT draft_id, '$.summary.claims[' || i || '].evidence_refs[0]' AS path, p AS ref_id FROM l UNION ALL SELECT draft_id, '$.summary.claims[' || i || '].evidence_refs[1]', s FROM l
 UNION ALL SELECT draft_id, '$.summary.claims[' || i || '].notes.counterevidence_refs[0]', 'p' || (l_partkey + 1) FROM l)
SELECT draft_id, path, ref_id, 'original body not provided' AS reason FROM c WHERE draft_id % 97 <> 0 AND (draft_id, ref_id) NOT IN (SELECT (draft_id, ref_id) FROM provided)
UNION ALL SELECT draft_id, '$.read_requests[' || i || ']', r, 'not an available unread catalog entry' FROM l WHERE draft_id % 97 <> 0 AND ((draft_id, r) NOT IN (SELECT (draft_id, ref_id) FROM readable) OR (draft_id, r) IN (SELECT (draft_id, ref_id) FROM provided))
UNION ALL SELECT DISTINCT draft_id, '$', NULL, 'draft is not JSON' FROM l WHERE draft_id % 97 = 0"""


@query
def episode_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as episodes with their lines as events; customers are contexts, suppliers snapshots, parts feedback."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    i, c = F.col("o_orderkey"), F.col("o_custkey")
    episodes = o.select(
        i.alias("episode_id"), F.concat(F.lit("p"), c % 3).alias("project_id"), F.when(i % 4 != 0, i % 120).alias("snapshot_ref"), F.when(i % 5 != 0, c).alias("context_ref"),
        F.when(i % 7 != 0, c % 11).alias("task_id"), F.when(i % 3 != 0, F.lit("r1")).alias("task_revision"), (i % 6 == 0).alias("traced"))
    contexts = table(spark, sf_dir, "customer").filter("c_custkey % 50 <> 0").select(F.col("c_custkey").alias("context_id"), F.concat(F.lit("p"), F.when(F.col("c_custkey") % 40 == 0, 9).otherwise(F.col("c_custkey") % 3)).alias("project_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 120).alias("snapshot_digest"), (F.col("c_custkey") % 12).alias("task_ref"), F.when(F.col("c_custkey") % 9 == 0, "r2").otherwise("r1").alias("task_revision"))
    snapshots = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("snapshot_id"), F.concat(F.lit("p"), F.col("s_suppkey") % 3).alias("project_id"))
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    events = li.select(k.alias("episode_id"), F.when((k % 8 == 0) & (n == 2), 1).otherwise(n).cast("long").alias("event_id"), F.when(n > 1, F.when(k % 9 == 0, n + 5).otherwise(n - 1)).cast("long").alias("parent_event_id"), F.when(n == 3, k - k % 10).when(n == 4, k).alias("parent_episode_id"))
    links = li.select(k.alias("episode_id"), F.col("l_partkey").alias("feedback_id"))
    feedback = table(spark, sf_dir, "part").filter("p_partkey % 10 <> 0").join(links.groupBy(F.col("feedback_id").alias("p_partkey")).agg(F.min("episode_id").alias("subject_ref")), "p_partkey", "left").join(episodes.select(F.col("episode_id").alias("subject_ref"), "project_id"), "subject_ref", "left").select(F.col("p_partkey").alias("feedback_id"), F.coalesce("project_id", F.lit("none")).alias("project_id"), "subject_ref")
    return checks.episode_problems(episodes, events, links, feedback, snapshots, contexts)


ORACLES["episode_problems"] = """WITH e AS (SELECT o_orderkey AS i, 'p' || o_custkey % 3 AS p, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 120 END AS s, CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey % 11 END AS t, CASE WHEN o_orderkey % 3 <> 0 THEN 'r1' END AS r, o_orderkey % 6 = 0 AS traced FROM orders),
c AS (SELECT c_custkey AS c, 'p' || CASE WHEN c_custkey % 40 = 0 THEN 9 ELSE c_custkey % 3 END AS cp, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 120 END AS cs, c_custkey % 12 AS ct, CASE WHEN c_custkey % 9 = 0 THEN 'r2' ELSE 'r1' END AS cr FROM customer WHERE c_custkey % 50 <> 0),
s AS (SELECT s_suppkey AS s, 'p' || s_suppkey % 3 AS sp FROM supplier),
j AS (SELECT * FROM e LEFT JOIN s USING (s) LEFT JOIN c USING (c)),
v AS (SELECT l_orderkey AS i, CAST(CASE WHEN l_orderkey % 8 = 0 AND l_linenumber = 2 THEN 1 ELSE l_linenumber END AS BIGINT) AS v, CASE WHEN l_linenumber > 1 THEN CASE WHEN l_orderkey % 9 = 0 THEN l_linenumber + 5 ELSE l_linenumber - 1 END END AS pv,
 CASE l_linenumber WHEN 3 THEN l_orderkey - l_orderkey % 10 WHEN 4 THEN l_orderkey END AS pe FROM lineitem),
n AS (SELECT v.*, coalesce(pe, v.i) AS home, e.p, h.p AS hp, h.traced FROM v JOIN e ON e.i = v.i LEFT JOIN e h ON h.i = coalesce(pe, v.i) WHERE pv IS NOT NULL OR pe IS NOT NULL),
b AS (SELECT l_partkey AS f, min(l_orderkey) AS subject FROM lineitem GROUP BY l_partkey),
f AS (SELECT p_partkey AS f, coalesce(e.p, 'none') AS fp, subject FROM part LEFT JOIN b ON b.f = p_partkey LEFT JOIN e ON e.i = subject WHERE p_partkey % 10 <> 0),
l AS (SELECT l_orderkey AS i, e.p, l_partkey AS k, fp, subject FROM lineitem JOIN e ON e.i = l_orderkey LEFT JOIN f ON f.f = l_partkey),
r(record, problem, detail) AS (SELECT i, 'snapshot_missing', NULL FROM j WHERE s IS NOT NULL AND sp IS NULL UNION ALL SELECT i, 'snapshot_project', NULL FROM j WHERE sp <> p UNION ALL SELECT i, 'context_missing', NULL FROM j WHERE c IS NOT NULL AND cp IS NULL
 UNION ALL SELECT i, 'context_project', NULL FROM j WHERE cp <> p UNION ALL SELECT i, 'context_snapshot', NULL FROM j WHERE cs <> s UNION ALL SELECT i, 'context_task', NULL FROM j WHERE ct <> t UNION ALL SELECT i, 'context_revision', NULL FROM j WHERE cr <> r
 UNION ALL SELECT i, 'repeated_event', v FROM v GROUP BY i, v HAVING count(*) > 1
 UNION ALL SELECT i, 'parent_project', v FROM n WHERE home <> i AND hp <> p
 UNION ALL SELECT i, 'parent_event_absent', v FROM n WHERE pv IS NOT NULL AND hp IS NOT NULL AND (home = i OR NOT traced) AND NOT EXISTS (SELECT 1 FROM v w WHERE w.i = n.home AND w.v = n.pv)
 UNION ALL SELECT i, CASE WHEN fp IS NULL THEN 'feedback_missing' WHEN fp <> p THEN 'feedback_project' ELSE 'feedback_subject' END, k FROM l WHERE fp IS NULL OR fp <> p OR subject <> i)
SELECT CAST(record AS VARCHAR) AS record, problem, CAST(detail AS VARCHAR) AS detail FROM r"""


@query
def snapshot_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as skills of a snapshot for each 10 keys, with relations to near keys and a file each."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 10).cast("string").alias("snapshot_id"), F.col("p_partkey").alias("k"))
    k = F.col("k")
    name = lambda c: c.cast("string")
    skills = p.select("snapshot_id", name(k).alias("skill_id"), F.concat(F.lit("p"), (k % 77 == 0).cast("int")).alias("project_id"))
    snapshots = p.select("snapshot_id", F.lit("p0").alias("project_id")).distinct()
    needs = F.array_compact(F.array(F.when(k % 3 == 0, k + 1), F.when(k % 9 == 0, k + 1), F.when(k % 17 == 0, k - 1), F.when(k % 29 == 0, k)))
    fights = F.array_compact(F.array(F.when(k % 4 == 0, k + 1), F.when(k % 31 == 0, k)))
    file = F.array_compact(F.array(F.when(k % 2 == 0, F.concat(name(k), F.lit("/a"))), F.when(k % 23 == 0, F.concat(name(k + 1), F.lit("/b")))))
    each = lambda field, refs: p.select("snapshot_id", name(k).alias("skill_id"), F.lit(field).alias("field"), F.explode(refs.cast("array<string>")).alias("ref"))
    assets = p.filter("k % 2 = 0 and k % 13 <> 0 or k % 19 = 0").select("snapshot_id", F.concat(name(k), F.lit("/a")).alias("path"))
    return checks.snapshot_problems(snapshots, skills, each("depends_on", needs).unionByName(each("declared_conflicts", fights)).unionByName(each("asset_refs", file)), assets)


ORACLES["snapshot_problems"] = """WITH RECURSIVE p AS (SELECT p_partkey AS k, p_partkey // 10 AS s FROM part),
r AS (SELECT s, k, 'depends_on' AS field, k + 1 AS x FROM p WHERE k % 3 = 0 UNION ALL SELECT s, k, 'depends_on', k + 1 FROM p WHERE k % 9 = 0 UNION ALL SELECT s, k, 'depends_on', k - 1 FROM p WHERE k % 17 = 0 UNION ALL SELECT s, k, 'depends_on', k FROM p WHERE k % 29 = 0
 UNION ALL SELECT s, k, 'declared_conflicts', k + 1 FROM p WHERE k % 4 = 0 UNION ALL SELECT s, k, 'declared_conflicts', k FROM p WHERE k % 31 = 0),
a AS (SELECT s, k, k AS owner, k || '/a' AS path FROM p WHERE k % 2 = 0 UNION ALL SELECT s, k, k + 1, (k + 1) || '/b' FROM p WHERE k % 23 = 0),
h AS (SELECT s, k || '/a' AS path FROM p WHERE k % 2 = 0 AND k % 13 <> 0 OR k % 19 = 0),
v AS (SELECT r.* FROM r JOIN p ON p.s = r.s AND p.k = r.x WHERE r.x <> r.k),
c(root, node) AS (SELECT k, k FROM p UNION SELECT c.root, v.x FROM c JOIN v ON v.k = c.node AND v.field = 'depends_on'),
q(record, problem, detail) AS (
 SELECT s || '/' || k, 'skill_project', NULL FROM p WHERE k % 77 = 0 UNION ALL SELECT s || '/' || k, 'repeated_reference', field || ' ' || x FROM r GROUP BY s, k, field, x HAVING count(*) > 1
 UNION ALL SELECT DISTINCT s || '/' || k, 'reference_to_itself', field FROM r WHERE x = k UNION ALL SELECT DISTINCT r.s || '/' || r.k, 'unknown_reference', field || ' ' || x FROM r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.s = r.s AND p.k = r.x)
 UNION ALL SELECT s || '/' || k, 'asset_of_another', path FROM a WHERE owner <> k UNION ALL SELECT s || '/' || k, 'asset_missing', path FROM a WHERE (s, path) NOT IN (SELECT (s, path) FROM h)
 UNION ALL SELECT CAST(s AS VARCHAR), 'asset_unowned', path FROM h WHERE (s, path) NOT IN (SELECT (s, path) FROM a)
 UNION ALL SELECT DISTINCT p.s || '/' || x.root, 'dependency_cycle', NULL FROM c x JOIN c y ON x.root = y.node AND x.node = y.root AND x.root <> x.node JOIN p ON p.k = x.root
 UNION ALL SELECT DISTINCT p.s || '/' || x.root, 'dependency_conflict', NULL FROM c x JOIN c y ON x.root = y.root JOIN v ON v.field = 'declared_conflicts' AND v.k = x.node AND v.x = y.node JOIN p ON p.k = x.root)
SELECT record, problem, detail FROM q"""
