"""Queries over memory items: text functions, retrieval and governance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import governance as G
from quarry.operators import retrieval as R
from quarry.operators.lineage import cut
from quarry.plans.registry import ORACLES, query
from quarry.sources.adapters import AS_OF, memory_items, rubric_proxies, table, with_sql

TASK = "review the archive of the bucket and the the notes"
SCOPE = "src1"


def sql_rank(order_extra: str = "") -> str:
    """DuckDB's twin of the rank score."""
    text = "lower(concat_ws(' ', id, kind, scope, content, array_to_string(tags, ' ')))"
    found = " + ".join(f"CASE WHEN contains({text}, '{t}') THEN 3 ELSE 0 END" for t in R.task_terms(TASK))
    return f"({found} + CASE WHEN status = 'verified' THEN 2 ELSE 0 END + CASE WHEN kind = 'session' THEN 1 ELSE 0 END + confidence)"


LIVE = "status NOT IN ('rejected','outdated')"
STABLE = "confidence DESC, updated_at DESC, id"


@query
def infer_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.infer_kind(F.col("text")).alias("kind"))


ORACLES["infer_kind"] = """SELECT doc_id, CASE WHEN contains(t,'preference') OR contains(t,'prefrence') OR contains(t,'user') THEN 'personal'
 WHEN contains(t,'evidence') OR contains(t,'test') OR contains(t,'citation') THEN 'evidence' WHEN contains(t,'session') OR contains(t,'scratchpad') THEN 'session'
 ELSE 'project' END AS kind FROM (SELECT doc_id, lower(text) AS t FROM documents)"""


@query
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", T.excerpt(F.col("text"), 240).alias("excerpt"), T.keyword_excerpt(F.col("text"), "the").alias("around"))


ORACLES["excerpts"] = r"""SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 240) AS excerpt,
 CASE WHEN p < 1 THEN substr(text, 1, 240) ELSE substr(text, greatest(p - 1 - 80, 0) + 1, p - 1 + 3 + 160 - greatest(p - 1 - 80, 0)) END AS around
 FROM (SELECT *, strpos(lower(text), 'the') AS p FROM documents)"""


@query
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.token_set(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("tokens"), F.sha2(F.concat_ws(" ", F.array_sort(t)), 256).alias("digest"), T.token_estimate(F.col("text")).alias("estimate"))


ORACLES["token_sets"] = """SELECT doc_id, CAST(len(s) AS BIGINT) AS tokens, sha256(array_to_string(list_sort(s), ' ')) AS digest, CAST(ceil(strlen(text) / 3.0) AS BIGINT) AS estimate
 FROM (SELECT doc_id, text, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS s FROM documents)"""


def terms_of(d: DataFrame, text: Column) -> DataFrame:
    d = d.select("doc_id", F.concat(text, F.lit(" 数据处理 与 a the")).alias("t"))
    return d.select("doc_id", F.concat_ws("|", T.terms(F.col("t"))).alias("terms"))


@query
def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms_of(table(spark, sf_dir, "documents"), F.col("text"))


ORACLES["query_terms"] = """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(
 list_filter(regexp_extract_all(lower(t), '[a-z0-9_]+'), lambda x: x NOT IN ('a','an','and','be','for','in','is','must','of','or','the','to','with')), ['数据','据处','处理','与']))), '|') AS terms
 FROM (SELECT doc_id, concat(text, ' 数据处理 与 a the') AS t FROM documents)"""


@query
def slugs_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    page = F.concat(F.lit("intro\n# Page "), F.col("page_id"), F.lit(" \nbody"))
    return p.select("page_id", T.slug(F.col("url")).alias("slug"), T.title(page, F.col("url")).alias("title"), F.element_at(F.split("url", ":"), -1).alias("target"))


ORACLES["slugs_and_titles"] = """SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, 'Page ' || page_id AS title,
 str_split(url, ':')[-1] AS target FROM pages"""


@query
def failure_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    t = F.concat(F.lit("x "), F.when(i % 3 == 0, "DISK_ERROR_7 ").otherwise(""), F.when(i % 2 == 0, "ValueError: ").otherwise("fine "), F.when(i % 5 == 0, "HASH_MISMATCH DISK_ERROR_7").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(",", T.failure_terms(t)).alias("failures"))


ORACLES["failure_words"] = """SELECT event_id, array_to_string(list_filter([
 CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN 'DISK_ERROR_7' END, CASE WHEN event_id % 5 = 0 THEN 'HASH_MISMATCH' END, CASE WHEN event_id % 2 = 0 THEN 'ValueError' END], lambda x: x IS NOT NULL), ',') AS failures FROM events"""


@query
def text_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.text_windows(F.col("text"), 1000)).alias("piece", "part")).select("doc_id", F.col("piece").cast("long").alias("piece"), F.sha2("part", 256).alias("digest"))


ORACLES["text_windows"] = """SELECT doc_id, piece, sha256(substr(text, CAST(piece * 1000 + 1 AS BIGINT), 1000)) AS digest
 FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 1000.0) AS BIGINT), 1))) AS piece FROM documents)"""


@query
def rank_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rank_memory(memory_items(spark, sf_dir), TASK, 25)


ORACLES["rank_memory"] = with_sql("memory_items") + f"""
SELECT CAST(row_number() OVER (ORDER BY {sql_rank()} DESC, updated_at DESC, id) AS INTEGER) AS rank, id, kind, round({sql_rank()}, 6) AS score
FROM memory_items WHERE {LIVE} QUALIFY rank <= 25"""


@query
def query_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory_items(spark, sf_dir)
    out = None
    for kind, limit in (("personal", None), ("project", 70), ("evidence", 12), ("session", 7)):
        part = R.query_memory(items, kind, limit, SCOPE).select("kind", "rank", "id", "scope", "status")
        out = part if out is None else out.unionByName(part)
    return out


ORACLES["query_memory"] = with_sql("memory_items") + f"""
SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY {STABLE}) AS INTEGER) AS rank, id, scope, status FROM memory_items
WHERE {LIVE} AND (kind = 'session' OR status = 'verified') AND (kind <> 'project' OR contains(scope, '{SCOPE}'))
QUALIFY rank <= CASE kind WHEN 'personal' THEN 5 WHEN 'project' THEN 50 WHEN 'evidence' THEN 12 ELSE 7 END"""


@query
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.context_pack(memory_items(spark, sf_dir), TASK, SCOPE)


ORACLES["context_pack"] = with_sql("memory_items") + f""",
scoped AS (SELECT *, {sql_rank()} AS s FROM memory_items WHERE {LIVE} AND (contains(scope, '{SCOPE}') OR (kind = 'personal' AND status = 'verified'))),
parts AS (
 SELECT 'always_loaded' AS section, 5 AS most, CAST(row_number() OVER (ORDER BY {STABLE}) AS INTEGER) AS rank, * FROM scoped WHERE kind = 'personal' AND status = 'verified'
 UNION ALL SELECT 'project_core', 5, CAST(row_number() OVER (ORDER BY {STABLE}) AS INTEGER), * FROM scoped WHERE kind = 'project' AND status = 'verified' AND contains(scope, '{SCOPE}')
 UNION ALL SELECT 'retrieved', 3, CAST(row_number() OVER (ORDER BY s DESC, updated_at DESC, id) AS INTEGER), * FROM scoped WHERE kind IN ('project','evidence')
 UNION ALL SELECT 'session_memory', 3, CAST(row_number() OVER (ORDER BY s DESC, updated_at DESC, id) AS INTEGER), * FROM scoped WHERE kind = 'session'
 UNION ALL SELECT 'evidence_memory', 3, CAST(row_number() OVER (ORDER BY s DESC, updated_at DESC, id) AS INTEGER), * FROM scoped WHERE kind = 'evidence')
SELECT section, rank, id, kind, scope, status, confidence FROM parts WHERE rank <= most"""


@query
def item_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.item_states(memory_items(spark, sf_dir), AS_OF)


def sql_days(ts: str) -> str:
    return f"CAST(floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms({ts})) / 86400000.0) AS BIGINT)"


SQL_STATES = with_sql("memory_items") + f""",
states AS (SELECT id, kind, scope, status,
 coalesce(x <= 0, false) AS expired, coalesce(x > 0 AND x <= 7*86400000, false) AS expiring_soon,
 coalesce(age >= CASE kind WHEN 'personal' THEN 365 WHEN 'project' THEN 180 WHEN 'evidence' THEN 90 ELSE 7 END, false) AS ttl_breach,
 kind <> 'session' AND idle >= 30 AS stale, retrieval_count >= 3 AND status = 'verified' AS reinforce,
 coalesce(kind <> 'session' AND retrieval_count = 0 AND upd >= 14, false) AS decay, over AS oversized,
 status = 'verified' AND retrieval_count > 0 AND idle < 30 AND NOT over AS keep
 FROM (SELECT *, epoch_ms(expires_at) - epoch_ms(TIMESTAMP '{AS_OF}') AS x, {sql_days('created_at')} AS age, {sql_days('updated_at')} AS upd,
  coalesce({sql_days('last_retrieved_at')}, {sql_days('updated_at')}) AS idle,
  length(content) > CASE kind WHEN 'personal' THEN 2000 WHEN 'project' THEN 4000 WHEN 'evidence' THEN 6000 ELSE 3000 END AS over FROM memory_items))"""
ORACLES["item_states"] = SQL_STATES + "\nSELECT * FROM states"


@query
def integrity_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory_items(spark, sf_dir)
    n = F.col("id").cast("long")
    now = items.select("id", F.when(n % 16 == 6, F.sha2("id", 256)).when(n % 16 != 2, F.sha2("content", 256)).alias("current_hash"))
    return G.integrity_markers(items, AS_OF, now)


SQL_MARKERS = f"""markers AS (
 SELECT 'missing_verified_at' AS marker, id, CAST(NULL AS VARCHAR) AS detail FROM memory_items WHERE status IN ('verified','outdated') AND verified_at IS NULL
 UNION ALL SELECT 'expired', id, NULL FROM memory_items WHERE expires_at <= TIMESTAMP '{AS_OF}'
 UNION ALL SELECT 'never_retrieved', id, NULL FROM memory_items WHERE kind IN ('evidence','project') AND retrieval_count = 0
 UNION ALL SELECT 'missing_source_hash', id, NULL FROM memory_items WHERE kind = 'evidence' AND source_hash IS NULL
 UNION ALL SELECT 'source_drift', id, NULL FROM memory_items WHERE kind = 'evidence' AND source_hash IS NOT NULL AND CAST(id AS BIGINT) % 16 = 6
 UNION ALL SELECT DISTINCT 'dangling_reference', id, r FROM (SELECT id, unnest(refs) AS r FROM memory_items) WHERE r NOT IN (SELECT id FROM memory_items))"""
ORACLES["integrity_markers"] = with_sql("memory_items") + ",\n" + SQL_MARKERS + "\nSELECT * FROM markers"


@query
def semantic_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.semantic_conflicts(memory_items(spark, sf_dir))


ORACLES["semantic_conflicts"] = with_sql("memory_items") + """
SELECT kind, scope, tag, count(DISTINCT claim) AS contents, count(*) AS items FROM (SELECT kind, scope, claim, unnest(list_distinct(tags)) AS tag FROM memory_items) GROUP BY ALL HAVING count(DISTINCT claim) > 1"""


@query
def direct_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One scope for all, so that both polarities of a claim can meet.
    return G.direct_contradictions(memory_items(spark, sf_dir).withColumns({"scope": F.lit("all"), "kind": F.lit("any")}))


ORACLES["direct_contradictions"] = with_sql("memory_items") + """,
c AS (SELECT 'any' AS kind, 'all' AS scope, unnest(list_distinct(tags)) AS tag, 'archive bucket ' || (CAST(id AS BIGINT) % 5) AS claim_key, id, CAST(id AS BIGINT) % 6 AS p FROM memory_items WHERE CAST(id AS BIGINT) % 6 < 2)
SELECT kind, scope, tag, claim_key, string_agg(id, ',' ORDER BY id) FILTER (p = 0) AS positive_ids, string_agg(id, ',' ORDER BY id) FILTER (p = 1) AS negative_ids
FROM c GROUP BY ALL HAVING count(*) FILTER (p = 0) > 0 AND count(*) FILTER (p = 1) > 0"""


@query
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("content"))
    return G.near_duplicates(items, "lang", 0.72)


ORACLES["near_duplicates"] = """WITH s AS (SELECT doc_id AS id, lang, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS t FROM documents),
e AS (SELECT id, lang, len(t) AS n, unnest(t) AS tok FROM s),
p AS (SELECT a.id AS a_id, b.id AS b_id, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM e a JOIN e b ON a.lang = b.lang AND a.tok = b.tok AND a.id < b.id
 AND least(a.n, b.n) >= 0.72 * greatest(a.n, b.n) - 1e-9 GROUP BY a.id, b.id)
SELECT a_id, b_id, round(c / CAST(an + bn - c AS DOUBLE), 3) AS similarity FROM p WHERE c / CAST(an + bn - c AS DOUBLE) >= 0.72"""


def consolidation(items: DataFrame, lean: DataFrame | None = None) -> DataFrame:
    """target: near-duplicates of one kind, conflicts and contradictions, as one list without repeats; ``lean`` has the items without contents."""
    lean = items if lean is None else lean
    pairs = G.near_duplicates(items, "kind", 0.72).withColumn("target", F.concat_ws("<->", "a_id", "b_id"))
    conflicts = G.semantic_conflicts(lean).select(F.concat_ws(":", F.lit("semantic_conflict"), "kind", "scope", "tag").alias("target"))
    contradictions = G.direct_contradictions(lean).select(F.concat_ws(":", F.lit("direct_contradiction"), "kind", "scope", "tag", "claim_key").alias("target"))
    # Where ids are of one item each, the targets of pairs differ from all others, but for ids that look like targets; only those are compared.
    once = lean.groupBy("id").count().filter("count > 1").isEmpty()
    odd = F.contains("a_id", F.lit("<->")) | F.contains("b_id", F.lit("<->")) | F.startswith("target", F.lit("semantic_conflict:")) | F.startswith("target", F.lit("direct_contradiction:")) | F.lit(not once)
    return pairs.filter(~odd).select("target").union(pairs.filter(odd).select("target").union(conflicts).union(contradictions).distinct())


@query
def vault_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory_items(spark, sf_dir)
    # Only near-duplicates read contents; all else is one table without them, so they do not join the labels again.
    lean = cut(items.withColumn("length", F.length("content")).drop("content"))
    return G.health(G.item_states(lean, AS_OF), consolidate=consolidation(items, lean).count(), integrity=G.integrity_markers(lean, AS_OF).count())


#: Near-duplicates of one kind, conflicts and contradictions of memory_items.
CONSOLIDATION = """
n AS (SELECT id, kind, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS t FROM memory_items),
w AS (SELECT id, kind, len(t) AS n, unnest(t) AS tok FROM n),
q AS (SELECT a.id AS l, b.id AS r, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS c FROM w a JOIN w b ON a.kind = b.kind AND a.tok = b.tok AND a.id < b.id
 AND least(a.n, b.n) >= 0.72 * greatest(a.n, b.n) - 1e-9 GROUP BY a.id, b.id),
g AS (SELECT kind, scope, claim, unnest(list_distinct(tags)) AS tag FROM memory_items),
consolidation AS (SELECT l || '<->' || r AS target FROM q WHERE c / CAST(an + bn - c AS DOUBLE) >= 0.72
 UNION SELECT 'semantic_conflict:' || kind || ':' || scope || ':' || tag FROM g GROUP BY kind, scope, tag HAVING count(DISTINCT claim) > 1
 UNION SELECT 'direct_contradiction:' || kind || ':' || scope || ':' || tag || ':archive bucket ' || b FROM (
  SELECT kind, scope, CAST(id AS BIGINT) % 5 AS b, CAST(id AS BIGINT) % 6 AS p, unnest(list_distinct(tags)) AS tag FROM memory_items WHERE CAST(id AS BIGINT) % 6 < 2)
  GROUP BY kind, scope, tag, b HAVING count(*) FILTER (p = 0) > 0 AND count(*) FILTER (p = 1) > 0)"""
ORACLES["vault_health"] = SQL_STATES + "," + CONSOLIDATION + """,
markers AS (SELECT coalesce(sum(CAST(status IN ('verified','outdated') AND verified_at IS NULL AS INTEGER) + CAST(coalesce(expires_at <= TIMESTAMP '{AS_OF}', false) AS INTEGER)
 + CAST(kind IN ('evidence','project') AND coalesce(retrieval_count, 0) = 0 AS INTEGER) + CAST(kind = 'evidence' AND source_hash IS NULL AS INTEGER)), 0)
 + (SELECT count(*) FROM (SELECT DISTINCT id, unnest(refs) AS r FROM memory_items) WHERE r NOT IN (SELECT id FROM memory_items)) AS n FROM memory_items),
c AS (SELECT count(*) AS items, count(*) FILTER (keep) AS keep, count(*) FILTER (reinforce) AS reinforce, count(*) FILTER (decay) AS decay,
 count(*) FILTER (expired) + count(*) FILTER (expiring_soon) + count(*) FILTER (ttl_breach) AS expire, (SELECT count(*) FROM consolidation) AS consolidate,
 CAST(count(*) FILTER (oversized) + count(*) FILTER (stale) + count(*) FILTER (decay) + (SELECT n FROM markers) AS BIGINT) AS review FROM states)
SELECT *, round(greatest(0.0, least(1.0, 1 - (decay + consolidate + review + expire) / CAST(greatest(2*items, 1) AS DOUBLE))), 3) AS score FROM c""".replace("{AS_OF}", AS_OF)


@query
def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.proposals(G.item_states(memory_items(spark, sf_dir), AS_OF))


SQL_PROPOSALS = SQL_STATES + """,
proposals AS (SELECT id, kind, 'expire' AS type, 'low' AS risk, 5 AS score, 'apply' AS decision FROM states WHERE kind = 'session' AND (expired OR ttl_breach)
 UNION ALL SELECT id, kind, 'decay', 'medium', 3, 'review' FROM states WHERE decay UNION ALL SELECT id, kind, 'budget', 'medium', 3, 'review' FROM states WHERE oversized)"""
ORACLES["proposals"] = SQL_PROPOSALS + "\nSELECT * FROM proposals"


@query
def applied_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory_items(spark, sf_dir)
    return G.applied(items, G.proposals(G.item_states(items, AS_OF))).groupBy("kind", "status").agg(F.count("*").alias("items"))


ORACLES["applied_proposals"] = SQL_PROPOSALS + """
SELECT m.kind, CASE WHEN p.id IS NOT NULL THEN 'outdated' ELSE m.status END AS status, count(*) AS items
FROM memory_items m LEFT JOIN (SELECT DISTINCT id FROM proposals WHERE decision = 'apply') p ON m.id = p.id GROUP BY ALL"""


@query
def feedback_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rubric_proxies(spark, sf_dir)
    scores = p.select(F.col("criterion").alias("series"), F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 7 != 0, F.col("score")).alias("score"))
    asked = table(spark, sf_dir, "documents").select(F.col("source").alias("series")).union(table(spark, sf_dir, "documents").select(F.concat("source", F.lit("-new"))))
    return G.feedback_trend(scores, 5, 3.5, asked)


ORACLES["feedback_trend"] = with_sql("rubric_proxies") + """,
t AS (SELECT criterion AS series, doc_id AS seq, CASE WHEN doc_id % 7 <> 0 THEN score END AS score FROM rubric_proxies QUALIFY row_number() OVER (PARTITION BY criterion ORDER BY doc_id DESC) <= 5),
h AS (SELECT series, count(*) AS n, round(coalesce(avg(score), 0), 3) AS mean, arg_max_null(score, seq) AS latest, arg_min_null(score, seq) AS first FROM t GROUP BY series),
a AS (SELECT source AS series FROM documents UNION SELECT source || '-new' FROM documents)
SELECT series, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean, round(coalesce(latest, 0) - coalesce(first, latest, 0), 3) AS delta,
 list_concat(CASE WHEN latest < 3.5 THEN ['below_min_score:' || latest || '/3.5'] ELSE [] END, CASE WHEN n IS NULL THEN ['no_feedback_history'] ELSE [] END) AS alerts FROM a LEFT JOIN h USING (series)"""


@query
def consolidation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consolidation(memory_items(spark, sf_dir))


ORACLES["consolidation_list"] = with_sql("memory_items") + "," + CONSOLIDATION + "\nSELECT target FROM consolidation"


@query
def fact_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = memory_items(spark, sf_dir).filter("status = 'verified'").select("scope", (-F.col("confidence")).alias("o"), "id", F.length("content").cast("long").alias("cost"))
    return R.budgeted(items, "scope", ["o", "id"], "cost", 12000).withColumnRenamed("used", "used_chars")


ORACLES["fact_budget"] = with_sql("memory_items", recursive=True) + """,
f AS (SELECT scope, id, length(content) AS cost, row_number() OVER (PARTITION BY scope ORDER BY -confidence, id) AS rn FROM memory_items WHERE status = 'verified'),
r AS (SELECT DISTINCT scope, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS kept, CAST('' AS VARCHAR) AS ids FROM f
 UNION ALL SELECT r.scope, f.rn, CASE WHEN r.used + f.cost + CASE WHEN r.kept > 0 THEN 1 ELSE 0 END <= 12000 THEN r.used + f.cost + CASE WHEN r.kept > 0 THEN 1 ELSE 0 END ELSE r.used END,
  CASE WHEN r.used + f.cost + CASE WHEN r.kept > 0 THEN 1 ELSE 0 END <= 12000 THEN r.kept + 1 ELSE r.kept END,
  CASE WHEN r.used + f.cost + CASE WHEN r.kept > 0 THEN 1 ELSE 0 END <= 12000 THEN CASE WHEN r.kept > 0 THEN r.ids || ',' ELSE '' END || f.id ELSE r.ids END
 FROM r JOIN f ON f.scope = r.scope AND f.rn = r.rn + 1)
SELECT scope, used AS used_chars, kept, ids FROM r QUALIFY row_number() OVER (PARTITION BY scope ORDER BY rn DESC) = 1"""
