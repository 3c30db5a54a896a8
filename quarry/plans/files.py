"""Queries that go through files: vaults, logs, collections, traces and byte ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y

from quarry.operators import events as E
from quarry.operators.lineage import new_folder
from quarry.plans.registry import ORACLES, query
from quarry.plans.runs import EVENTS, events
from quarry.sources import adapters, vault
from quarry.sources.adapters import table, with_sql
from quarry.streaming import trace_index


def trimmed(column: str) -> str:
    """DuckDB: the text without white space at its ends."""
    return rf"regexp_replace({column}, '^[ \t\n\v\f\r]+|[ \t\n\v\f\r]+$', '', 'g')"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory items as they are read from their Markdown files."""
    return vault.parse_items(vault.serialized(adapters.memory_items(spark, sf_dir).drop("source_hash", "tags", "claim")))


@query
def vault_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).select("path", "id", "kind", "scope", "status", "confidence", "retrieval_count", F.sha2("content", 256).alias("digest"))


ORACLES["vault_items"] = with_sql("memory_items") + f"""
SELECT CASE kind WHEN 'personal' THEN 'people' WHEN 'project' THEN 'projects' WHEN 'evidence' THEN 'notes' ELSE 'sessions' END || '/' || id || '.md' AS path, id, kind, scope, status, confidence, retrieval_count, sha256({trimmed("content")}) AS digest FROM memory_items"""


@query
def scope_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.scope_files(items(spark, sf_dir), "src1").select("id", "path")


ORACLES["scope_files"] = with_sql("memory_items") + """
SELECT id, CASE kind WHEN 'personal' THEN 'people' WHEN 'project' THEN 'projects' WHEN 'evidence' THEN 'notes' ELSE 'sessions' END || '/' || id || '.md' AS path FROM memory_items WHERE contains(scope, 'src1')"""


@query
def unreadable_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = vault.serialized(adapters.memory_items(spark, sf_dir).drop("source_hash", "tags", "claim"))
    broken = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long") % 9 == 0
    return vault.unreadable(files.withColumn("content", F.when(broken, F.regexp_replace("content", r"\A---\n", "")).otherwise(F.col("content"))))


ORACLES["unreadable_files"] = with_sql("memory_items") + """
SELECT CASE kind WHEN 'personal' THEN 'people' WHEN 'project' THEN 'projects' WHEN 'evidence' THEN 'notes' ELSE 'sessions' END || '/' || id || '.md' AS path, 'unreadable' AS marker FROM memory_items WHERE CAST(id AS BIGINT) % 9 = 0"""


@query
def legacy_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = vault.serialized(adapters.memory_items(spark, sf_dir).drop("source_hash", "tags", "claim"))
    i = F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    files = files.withColumn("content", F.when(i % 9 == 0, F.regexp_replace("content", r"\A---\n", "")).when(i % 10 == 1, F.lit("---\nnot json\n---\n\nbody")).otherwise(F.col("content")))
    return vault.legacy_files(files, "src1").select("legacy_path", "state", "memory_id", "kind", "project_id", F.sha2("content", 256).alias("digest"))


ORACLES["legacy_facts"] = with_sql("memory_items") + f""",
m AS (SELECT *, CAST(id AS BIGINT) % 9 = 0 OR CAST(id AS BIGINT) % 10 = 1 AS broken, CASE kind WHEN 'personal' THEN 'people' WHEN 'project' THEN 'projects' WHEN 'evidence' THEN 'notes' ELSE 'sessions' END || '/' || id || '.md' AS path FROM memory_items)
SELECT path AS legacy_path, CASE WHEN broken THEN 'LEGACY_PARSE_ERROR' ELSE 'fact' END AS state, CASE WHEN NOT broken THEN id END AS memory_id, CASE WHEN broken THEN NULL WHEN kind = 'personal' THEN 'user' ELSE 'project' END AS kind,
 CASE WHEN NOT broken AND kind = 'project' THEN 'src1' END AS project_id, CASE WHEN NOT broken THEN sha256({trimmed("content")}) END AS digest
FROM m WHERE broken OR (status = 'verified' AND (kind = 'personal' OR (kind = 'project' AND scope = 'src1')))"""


@query
def knowledge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.search_files(table(spark, sf_dir, "pages").select(F.col("url").alias("path"), F.col("html").alias("content")), "THE", 20).select("path", F.sha2("content", 256).alias("digest"))


ORACLES["knowledge_search"] = "SELECT url AS path, sha256(html) AS digest FROM pages WHERE contains(lower(html), 'the') ORDER BY url LIMIT 20"


def page_reports(spark: SparkSession, sf_dir: str, copies: int) -> str:
    """A folder with reports over the pages, one for each 25 of them, as text files, each in several folders; the root's path."""
    root = new_folder(spark, "reports")
    pages = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 25).cast("string").alias("part"), F.concat_ws(" ", F.lpad("page_id", 9, "0"), "url", F.sha2("html", 256)).alias("line"))
    text = vault.report_text(pages, "part", "line")
    at = F.explode(F.array(*map(F.lit, range(copies))))
    text.select(at.alias("copy"), "*").select(F.concat(F.when(F.col("part") == "0", "reports").otherwise(F.concat(F.lit("r"), "part")), F.lit("-"), "copy").alias("folder"), "text").write.partitionBy("folder").text(root)
    return root


REPORTS = r"""WITH t AS (SELECT page_id // 25 AS k, '## ' || page_id // 25 || chr(10) || chr(10) || string_agg('- ' || lpad(CAST(page_id AS VARCHAR), 9, '0') || ' ' || url || ' ' || sha256(html), chr(10) ORDER BY page_id) || chr(10) AS text FROM pages GROUP BY 1)"""


@query
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = vault.markdown_files(spark, page_reports(spark, sf_dir, 1), ("folder=reports-0",), "*.txt")
    return files.select(F.split("path", "/")[0].alias("folder"), F.sha2("content", 256).alias("digest"), "bytes")


ORACLES["report_files"] = REPORTS + "\nSELECT 'folder=r' || k || '-0' AS folder, sha256(text) AS digest, CAST(strlen(text) AS BIGINT) AS bytes FROM t WHERE k <> 0"


@query
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = vault.content_hashes(spark, page_reports(spark, sf_dir, 1))
    return files.filter(F.col("path").endswith(".txt")).select(F.regexp_extract("path", r"folder=([^/]+)/", 1).alias("folder"), "current_hash", "bytes")


ORACLES["file_hashes"] = REPORTS + "\nSELECT CASE k WHEN 0 THEN 'reports' ELSE 'r' || k END || '-0' AS folder, sha256(text) AS current_hash, CAST(strlen(text) AS BIGINT) AS bytes FROM t"


@query
def imported_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.imported_traces(spark, page_reports(spark, sf_dir, 3)).filter(F.col("file").endswith(".txt")).select("trace_id", "copies", "bytes", F.decode("content", "UTF-8").alias("content"))


ORACLES["imported_traces"] = REPORTS + "\nSELECT sha256(text) AS trace_id, CAST(3 AS BIGINT) AS copies, CAST(strlen(text) AS BIGINT) AS bytes, text AS content FROM t"


@query
def typed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "customers")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.concat("c_name", F.lit(', "a"'))).alias("c_name"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal")).alias("c_acctbal"))
    c.write.option("header", True).option("escape", '"').csv(path)
    return vault.typed_csv(spark, path, {"c_custkey": "long", "c_name": "string", "c_acctbal": "double"})


ORACLES["typed_customers"] = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_name || ', "a"' END AS c_name, CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END AS c_acctbal FROM customer"""


@query
def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "log")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    schema = Y.StructType([Y.StructField("event_id", Y.LongType()), Y.StructField("event_type", Y.StringType()), Y.StructField("value", Y.DoubleType())])
    missing = vault.json_lines(spark, path, schema)
    vault.append_json(e.filter("event_id % 2 = 0"), path)
    vault.append_json(e.filter("event_id % 2 = 1"), path)
    return vault.json_lines(spark, path, schema).union(missing)


ORACLES["json_log"] = "SELECT event_id, event_type, value FROM events"


@query
def intact_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("payload"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 6 == 0, "x").otherwise("")), 256).alias("digest"))
    return vault.verified_records(d).select("doc_id", "intact")


ORACLES["intact_records"] = "SELECT doc_id, doc_id % 6 <> 0 AS intact FROM documents"


@query
def touched_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "events").select((F.col("event_id") % 300).cast("string").alias("id"), F.col("ts").cast("timestamp").alias("at"))
    return vault.touched(seen, adapters.memory_items(spark, sf_dir)).select("id", "retrieval_count", F.unix_micros("last_retrieved_at").alias("last"), F.unix_micros("updated_at").alias("updated"))


ORACLES["touched_items"] = with_sql("memory_items") + """,
s AS (SELECT CAST(event_id % 300 AS VARCHAR) AS id, count(DISTINCT ts) AS n, max(ts) AS seen FROM events GROUP BY 1)
SELECT m.id, CAST(retrieval_count + coalesce(n, 0) AS INTEGER) AS retrieval_count, epoch_us(greatest(last_retrieved_at, seen)) AS last, epoch_us(greatest(updated_at, seen)) AS updated FROM memory_items m LEFT JOIN s ON s.id = m.id"""


@query
def listed_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.listed(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey"), "s_nationkey", "s_suppkey")


ORACLES["listed_suppliers"] = "SELECT s_nationkey, s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY sha256(CAST(s_suppkey AS VARCHAR))) AS INTEGER) AS place FROM supplier"


@query
def mixed_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return vault.mixed_registry(memory=s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), disk=c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))


ORACLES["mixed_registry"] = "SELECT s_suppkey AS id, s_name AS name, 'memory' AS origin, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, 'disk', c_mktsegment FROM customer"


@query
def selected_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vault.selected(table(spark, sf_dir, "orders"), o_orderstatus="F", o_custkey=None).select("o_orderkey", "o_custkey")


ORACLES["selected_orders"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'"


@query
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trace_rows(events(spark, sf_dir), "kind = 'action' and position > 3", 40).select("event_id", "episode_id", "position")


ORACLES["trace_rows"] = EVENTS + "\nSELECT event_id, episode_id, position FROM episode_events WHERE kind = 'action' AND position > 3 ORDER BY position, event_id LIMIT 40"


@query
def trace_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.trace_rows(events(spark, sf_dir), "event_id = 77").select("event_id", "episode_id", "kind", "call_id")


ORACLES["trace_lookup"] = EVENTS + "\nSELECT event_id, episode_id, kind, call_id FROM episode_events WHERE event_id = 77"


@query
def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.col("doc_id")
    reads = d.select(n.alias("read_id"), "doc_id", (n % 700).alias("start"), (n % 700 + n % 5 * 600).alias("stop"))
    broken = F.when((n % 50 == 0) & (F.col("chunk_no") == 0), "x").otherwise(F.col("digest"))
    got = vault.read_ranges(vault.chunked(d, "doc_id", "text").withColumn("digest", broken), reads, "doc_id")
    return got.select("read_id", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("body_digest"), "intact")


ORACLES["read_ranges"] = """WITH x AS (SELECT doc_id AS i, doc_id % 700 AS a, doc_id % 5 * 600 AS n, encode(text) AS raw, strlen(text) AS bytes FROM documents WHERE doc_id % 5 > 0),
y AS (SELECT *, unhex(substr(hex(raw), 2 * a + 1, 2 * n)) AS body, (a + n - 1) // 1024 AS last FROM x)
SELECT i AS read_id, CAST(octet_length(body) AS BIGINT) AS bytes, sha256(body) AS body_digest, last < greatest(ceil(bytes / 1024), 1) AND i % 50 <> 0 AS intact FROM y"""


@query
def indexed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, target, state = (new_folder(spark, n) for n in ("traces", "index", "offsets"))
    e = events(spark, sf_dir).select(*[F.col(c).cast("string") for c in ("event_id", "episode_id", "kind", "call_id")])
    text = F.when(F.col("event_id") % 101 == 0, "broken").otherwise(F.to_json(F.struct("event_id", "episode_id", "kind", "call_id")))
    e.select(text.alias("value")).repartition(3).write.text(lines)
    trace_index.index_step(spark, lines, target, state)
    return spark.read.parquet(target).drop("trace")


ORACLES["indexed_traces"] = EVENTS + """,
x AS (SELECT *, event_id % 101 <> 0 AS ok, CASE WHEN event_id % 101 = 0 THEN 'broken' ELSE '{"event_id":"' || event_id || '","episode_id":"' || episode_id || '","kind":"' || kind || '"' || CASE WHEN call_id IS NULL THEN '' ELSE ',"call_id":"' || call_id || '"' END || '}' END AS v FROM episode_events)
SELECT CASE WHEN ok THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN ok THEN CAST(episode_id AS VARCHAR) END AS episode_id, CASE WHEN ok THEN kind END AS kind, CASE WHEN ok THEN call_id END AS call_id,
 CAST(strlen(v) AS BIGINT) AS bytes, sha256(v) AS digest, ok AS readable FROM x"""


@query
def byte_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = events(spark, sf_dir).select(F.col("episode_id").alias("trace"), "position", (F.length("kind") + F.col("event_id") % 50).alias("bytes"))
    return trace_index.byte_step(sizes, 3, 10, 300)


ORACLES["byte_steps"] = EVENTS + """
SELECT trace, position, bytes FROM (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS b FROM (SELECT episode_id AS trace, position, length(kind) + event_id % 50 AS bytes FROM episode_events WHERE position >= 3)
 WINDOW w AS (PARTITION BY trace ORDER BY position)) WHERE n <= 10 AND b <= 300"""
