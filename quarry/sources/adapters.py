"""The driver's tables in the shapes that the operators take.

Each adapter has its DuckDB twin in ``SQL``; both follow one rule per column, so operators can be checked side by side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
BASE = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(start: Column, n: Column) -> Column:
    return (start.cast("long") + n.cast("long") * 86400).cast("timestamp")


def memory_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, ("personal", "project", "evidence", "session"))), (i % 4 + 1).cast("int"))
    status = F.when(i % 17 == 0, "outdated").when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "verified").otherwise("candidate")
    created = days(F.lit(BASE).cast("timestamp"), -(i % 400))
    base = d.select(
        i.cast("string").alias("id"), kind.alias("kind"), F.col("source").alias("scope"), status.alias("status"),
        (F.col("n_chars") % 100 / F.lit(100.0)).alias("confidence"), F.col("text").alias("content"), created.alias("created_at"),
        days(created, i % 13).alias("updated_at"), i.alias("n"), F.col("lang"),
    )
    n = F.col("n")
    return base.select(
        "id", "kind", "scope", "status", "confidence", "content", "created_at", "updated_at",
        F.when(F.col("status").isin("verified", "outdated") & (n % 5 != 0), F.col("updated_at")).alias("verified_at"),
        F.when(F.col("kind") == "session", days(F.col("created_at"), F.lit(7))).when(n % 29 == 0, days(F.col("created_at"), F.lit(400))).alias("expires_at"),
        (n % 6).cast("int").alias("retrieval_count"),
        F.when(n % 6 > 0, days(F.col("updated_at"), n % 3)).alias("last_retrieved_at"),
        F.array_compact(F.array((n * 2).cast("string"), F.when(n % 3 == 0, (n + 1).cast("string")), F.when(n % 7 == 0, F.concat(F.lit("missing-"), n.cast("string"))))).alias("references"),
        F.when(n % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), (n % 5).cast("string")), F.col("lang"))).alias("tags"),
        F.when(n % 8 != 0, F.sha2(F.col("content"), 256)).alias("source_hash"),
        F.when(n % 6 == 0, F.concat(F.lit("Must archive bucket "), (n % 5).cast("string"), F.lit(".")))
        .when(n % 6 == 1, F.concat(F.lit("must  NOT archive bucket "), (n % 5).cast("string")))
        .otherwise(F.concat(F.lit("note "), n.cast("string"))).alias("claim"),
    )


def rubric_proxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", F.col("source").alias("criterion"), F.col("lang").alias("target"), (1 + 4 * F.col("quality") - F.col("toxic")).cast("double").alias("score"), (F.col("doc_id") % 2).cast("int").alias("n_evidence"))


def episode_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user, in order, with a kind, a call id, goals and a source role."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    i = F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, ("user_message", "action", "result", "observation", "failed"))), (i % 5 + 1).cast("int"))
    return e.select(
        "event_id", F.col("user_id").alias("episode_id"), F.row_number().over(w).cast("long").alias("position"), kind.alias("kind"),
        F.when(i % 5 > 0, F.concat(F.lit("c"), (k % 7).cast("string"))).alias("call_id"),
        F.when(i % 3 > 0, F.concat(F.lit("g"), (k % 3).cast("string"))).alias("goal_id"),
        F.concat(F.lit("r"), (i % 2).cast("string")).alias("task_revision"),
        F.when(i % 4 == 0, F.concat(F.lit("f"), (k % 10).cast("string"))).alias("resource"),
        F.when(i % 8 != 0, F.concat(F.lit("v"), (i % 2).cast("string"))).alias("version_ref"),
        F.when(i % 6 == 0, i - 1).alias("parent_event_id"), "value", "ts",
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage rows; a cost is unknown where there was no discount, and a currency for some rows."""
    li = table(spark, sf_dir, "lineitem")
    uid = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("l_extendedprice").cast("long"))
    return li.select(
        uid.alias("usage_id"), F.col("l_returnflag").alias("stage"),
        F.when(F.col("l_discount") != 0, F.col("l_extendedprice")).alias("monetary_cost"),
        F.when(F.col("l_linenumber") != 7, F.col("l_linestatus")).alias("currency"),
        F.when(F.col("l_tax") != 0, F.col("l_quantity").cast("long")).alias("input_tokens"),
        F.col("l_partkey").alias("key"),
    )


def planned_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    i = F.col("o_orderkey")
    split = F.element_at(F.array(*map(F.lit, ("target", "target", "regression", "transfer"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    return o.select(i.alias("request_id"), F.col("o_custkey").alias("case_id"), split.alias("split"), F.when(i % 2 == 0, "baseline").otherwise("candidate").alias("arm"), F.col("o_orderstatus").alias("binding"))


def request_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for most requests, with an outcome that may be unknown."""
    o = table(spark, sf_dir, "orders").filter("o_orderkey % 10 <> 0")
    price = F.col("o_totalprice")
    outcome = F.when(F.floor(price) % 5 == 0, F.lit(None).cast("string")).when(F.floor(price) % 3 == 0, "fail").otherwise("pass")
    return o.select(
        F.col("o_orderkey").alias("request_id"), outcome.alias("outcome"),
        F.when(F.floor(price) % 5 != 0, F.floor(price) % 100 / F.lit(100.0)).alias("score"),
        F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")).alias("binding"),
        F.when(F.col("o_orderkey") % 4 == 0, "terminal_error").otherwise("completed").alias("terminal_status"), price.alias("monetary_cost"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with revisions: a customer's orders, each superseding the one before."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("memory_id"), F.row_number().over(w).cast("long").alias("revision"), F.col("o_orderkey").alias("record_id"), F.lag("o_orderkey").over(w).alias("supersedes"), F.col("o_orderpriority").alias("content"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 == 0, "user").otherwise("project").alias("kind"))


def dependency_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys depending on one or two smaller ones, with a few cycles."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    half = p.select(F.col("k").alias("src"), F.floor(F.col("k") / 2).cast("long").alias("dst")).filter("src > 1 and dst >= 1")
    back = p.filter("k % 97 = 0").select(F.floor(F.col("k") / 2).cast("long").alias("src"), F.col("k").alias("dst"))
    return half.unionByName(back)


#: DuckDB twins of the adapters, as common table expressions.
SQL = {
    "memory_items": f"""memory_items AS (
 SELECT CAST(n AS VARCHAR) AS id, kind, scope, status, confidence, content, created_at, updated_at,
  CASE WHEN status IN ('verified','outdated') AND n % 5 <> 0 THEN updated_at END AS verified_at,
  CASE WHEN kind = 'session' THEN created_at + INTERVAL 7 DAY WHEN n % 29 = 0 THEN created_at + INTERVAL 400 DAY END AS expires_at,
  CAST(n % 6 AS INTEGER) AS retrieval_count,
  CASE WHEN n % 6 > 0 THEN updated_at + to_days(CAST(n % 3 AS INTEGER)) END AS last_retrieved_at,
  list_filter([CAST(n*2 AS VARCHAR), CASE WHEN n % 3 = 0 THEN CAST(n+1 AS VARCHAR) END, CASE WHEN n % 7 = 0 THEN 'missing-' || n END], lambda x: x IS NOT NULL) AS refs,
  CASE WHEN n % 11 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['t' || (n % 5), lang] END AS tags,
  CASE WHEN n % 8 <> 0 THEN sha256(content) END AS source_hash,
  CASE WHEN n % 6 = 0 THEN 'Must archive bucket ' || (n % 5) || '.' WHEN n % 6 = 1 THEN 'must  NOT archive bucket ' || (n % 5) ELSE 'note ' || n END AS claim
 FROM (SELECT *, created_at + to_days(CAST(n % 13 AS INTEGER)) AS updated_at FROM (
  SELECT d.doc_id AS n, ['personal','project','evidence','session'][d.doc_id % 4 + 1] AS kind, d.source AS scope,
   CASE WHEN d.doc_id % 17 = 0 THEN 'outdated' WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'verified' ELSE 'candidate' END AS status,
   (n_chars % 100) / CAST(100.0 AS DOUBLE) AS confidence, d.text AS content, TIMESTAMP '{BASE}' - to_days(CAST(d.doc_id % 400 AS INTEGER)) AS created_at, lang
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)))""",
    "rubric_proxies": """rubric_proxies AS (
 SELECT d.doc_id, source AS criterion, lang AS target, CAST(1 + 4*quality - toxic AS DOUBLE) AS score, CAST(d.doc_id % 2 AS INTEGER) AS n_evidence
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id)""",
    "episode_events": """episode_events AS (
 SELECT event_id, user_id AS episode_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position,
  ['user_message','action','result','observation','failed'][event_id % 5 + 1] AS kind,
  CASE WHEN event_id % 5 > 0 THEN 'c' || (k % 7) END AS call_id, CASE WHEN event_id % 3 > 0 THEN 'g' || (k % 3) END AS goal_id,
  'r' || (event_id % 2) AS task_revision, CASE WHEN event_id % 4 = 0 THEN 'f' || (k % 10) END AS resource,
  CASE WHEN event_id % 8 <> 0 THEN 'v' || (event_id % 2) END AS version_ref, CASE WHEN event_id % 6 = 0 THEN event_id - 1 END AS parent_event_id, value, ts
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))""",
    "usage": """usage AS (
 SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice) AS BIGINT)) AS usage_id, l_returnflag AS stage, CASE WHEN l_discount <> 0 THEN l_extendedprice END AS monetary_cost,
  CASE WHEN l_linenumber <> 7 THEN l_linestatus END AS currency, CASE WHEN l_tax <> 0 THEN CAST(trunc(l_quantity) AS BIGINT) END AS input_tokens, l_partkey AS key
 FROM lineitem)""",
    "planned_requests": """planned_requests AS (
 SELECT o_orderkey AS request_id, o_custkey AS case_id, ['target','target','regression','transfer'][o_custkey % 4 + 1] AS split,
  CASE WHEN o_orderkey % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS arm, o_orderstatus AS binding FROM orders)""",
    "request_results": """request_results AS (
 SELECT o_orderkey AS request_id, CASE WHEN floor(o_totalprice) % 5 = 0 THEN NULL WHEN floor(o_totalprice) % 3 = 0 THEN 'fail' ELSE 'pass' END AS outcome,
  CASE WHEN floor(o_totalprice) % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) % 100 / CAST(100.0 AS DOUBLE) END AS score,
  CASE WHEN o_orderkey % 9 = 0 THEN 'X' ELSE o_orderstatus END AS binding,
  CASE WHEN o_orderkey % 4 = 0 THEN 'terminal_error' ELSE 'completed' END AS terminal_status, o_totalprice AS monetary_cost
 FROM orders WHERE o_orderkey % 10 <> 0)""",
    "revisions": """revisions AS (
 SELECT o_custkey AS memory_id, row_number() OVER w AS revision, o_orderkey AS record_id, lag(o_orderkey) OVER w AS supersedes,
  o_orderpriority AS content, o_orderdate AS created_at, CASE WHEN o_orderkey % 3 = 0 THEN 'user' ELSE 'project' END AS kind
 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))""",
    "dependency_edges": """dependency_edges AS (
 SELECT p_partkey AS src, CAST(floor(p_partkey / 2) AS BIGINT) AS dst FROM part WHERE p_partkey > 1
 UNION ALL SELECT CAST(floor(p_partkey / 2) AS BIGINT), p_partkey FROM part WHERE p_partkey % 97 = 0)""",
}


def with_sql(*names: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(SQL[n] for n in names)
