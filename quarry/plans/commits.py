"""Queries over what writers leave and callers bring: items as files, a log that two writers share, pages, settings, functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import tools
from quarry.operators import callbacks
from quarry.operators.lineage import new_folder
from quarry.plans.files import trimmed
from quarry.plans.registry import ORACLES, query
from quarry.plans.vault import SCOPE, TASK
from quarry.sources import adapters, commits, items, vault
from quarry.sources.adapters import table, with_sql


@query
def written_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "vault")
    items.write_items(vault.serialized(adapters.memory_items(spark, sf_dir).drop("source_hash", "tags", "claim")), folder.removeprefix("file:"))
    files = items.read_items(spark, folder.removeprefix("file:")).filter(F.endswith("path", F.lit(".md"))).withColumn("content", F.col("content").cast("string"))
    return vault.parse_items(files).select("path", "id", "kind", "scope", "status", "confidence", F.sha2("content", 256).alias("digest"))


ORACLES["written_items"] = with_sql("memory_items") + f"""
SELECT CASE kind WHEN 'personal' THEN 'people' WHEN 'project' THEN 'projects' WHEN 'evidence' THEN 'notes' ELSE 'sessions' END || '/' || id || '.md' AS path, id, kind, scope, status, confidence, sha256({trimmed("content")}) AS digest FROM memory_items"""


@query
def release_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each priority's orders are a release; two writers try each one from the same generation, and one of them must lose.

    Between releases, notes of other keys are committed from an old generation and go in behind.
    """
    folder = new_folder(spark, "releases")
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("k")).orderBy("o_orderpriority").collect()
    digest, refused = None, []
    for r in o:
        at = commits.newest(spark, folder)
        for writer in ("first", "second"):
            try:
                commits.swap(spark, folder, at, digest, f"{r.o_orderpriority}-{r.n}", {"release": r.o_orderpriority, f"n-{r.o_orderpriority}": str(r.n)}, writer)
            except commits.Conflict:
                refused.append((at + 1, writer))
        commits.commit(spark, folder, 0, f"{r.o_orderpriority}-{r.n}", {f"note-{r.o_orderpriority}": str(r.k)}, "notes")
        digest = f"{r.o_orderpriority}-{r.n}"
    lost = spark.createDataFrame(refused, "generation long, writer string")
    held = commits.state(spark, folder).select("generation", F.lit("state").alias("what"), "key", "value")
    log = commits.entries(spark, folder).select("generation", F.lit("entry").alias("what"), F.col("writer").alias("key"), F.col("digest").alias("value"))
    return held.unionByName(log).unionByName(lost.select("generation", F.lit("refused").alias("what"), F.col("writer").alias("key"), F.lit(None).cast("string").alias("value")))


ORACLES["release_log"] = """WITH g AS (SELECT o_orderpriority AS p, count(*) AS n, min(o_orderkey) AS k, row_number() OVER (ORDER BY o_orderpriority) AS i FROM orders GROUP BY o_orderpriority)
SELECT CAST(2 * i - 1 AS BIGINT) AS generation, 'state' AS what, 'n-' || p AS key, CAST(n AS VARCHAR) AS value FROM g UNION ALL SELECT 2 * i, 'state', 'note-' || p, CAST(k AS VARCHAR) FROM g
UNION ALL SELECT 2 * max(i) - 1, 'state', 'release', max(p) FROM g
UNION ALL SELECT 2 * i - 1, 'entry', 'first', p || '-' || n FROM g UNION ALL SELECT 2 * i, 'entry', 'notes', p || '-' || n FROM g
UNION ALL SELECT 2 * i - 1, 'refused', 'second', NULL FROM g"""


@query
def page_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as the files of a knowledge base, of which three are read by their paths."""
    folder = new_folder(spark, "wiki")
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id") % 10, F.lit("/"), "page_id", F.lit(".md")).alias("path"), F.col("html").alias("content"))
    items.write_items(pages, folder.removeprefix("file:"))
    read = [vault.read_page(spark, folder, f"p/x/../{i % 10}/{i}.md") for i in (0, 7, 42)]
    return read[0].union(read[1]).union(read[2]).select("path", F.sha2("content", 256).alias("digest"))


ORACLES["page_reads"] = "SELECT 'p/' || page_id % 10 || '/' || page_id || '.md' AS path, sha256(html) AS digest FROM pages WHERE page_id IN (0, 7, 42)"


@query
def project_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as folders below their customers', some of which have settings, one in nine of them broken."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("w/"), "c_custkey").alias("folder"), F.col("c_custkey").alias("k"))
    text = F.when(F.col("k") % 9 == 0, "{broken").otherwise(F.to_json(F.struct(F.concat(F.lit("p"), "k").alias("defaultProject"), F.col("k").alias("limit"), F.array(F.concat(F.lit("b"), F.col("k") % 4)).alias("knowledgeBases"))))
    configs = c.filter("k % 3 = 0").select("folder", text.alias("text")).unionByName(c.limit(1).select(F.lit("w").alias("folder"), F.lit('{"defaultProject":"root"}').alias("text")))
    configs = configs.unionByName(table(spark, sf_dir, "orders").filter("o_orderkey % 50 = 0").select(F.concat_ws("/", F.lit("w"), "o_custkey", "o_orderkey").alias("folder"), F.lit('{"limit":1}').alias("text")))
    folders = table(spark, sf_dir, "orders").select(F.concat_ws("/", F.lit("w"), "o_custkey", "o_orderkey").alias("folder"))
    found = vault.resolved_settings(folders, configs, {"defaultProject": "general", "vaultRoot": "v"}, ["g"])
    s = F.col("settings")
    return found.select("folder", "config_folder", s["defaultProject"].alias("project"), s["vaultRoot"].alias("root"), s["limit"].alias("most"), F.array_join("bases", ",").alias("bases"))


ORACLES["project_settings"] = """WITH o AS (SELECT o_orderkey AS i, o_custkey AS k, 'w/' || o_custkey || '/' || o_orderkey AS folder, CASE WHEN o_orderkey % 50 = 0 THEN 'own' WHEN o_custkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer) THEN 'customer' ELSE 'root' END AS near FROM orders)
SELECT folder, CASE near WHEN 'own' THEN folder WHEN 'customer' THEN 'w/' || k ELSE 'w' END AS config_folder,
 CASE WHEN near = 'own' OR (near = 'customer' AND k % 9 = 0) THEN 'general' WHEN near = 'customer' THEN 'p' || k ELSE 'root' END AS project, 'v' AS root,
 CASE WHEN near = 'own' THEN '1' WHEN near = 'customer' AND k % 9 <> 0 THEN CAST(k AS VARCHAR) END AS most, CASE WHEN near = 'customer' AND k % 9 <> 0 THEN 'g,b' || k % 4 ELSE 'g' END AS bases FROM o"""


@query
def callback_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function over all documents, which fails on some of them."""
    def work(row: dict) -> str:
        if row["doc_id"] % 13 == 0:
            raise ValueError(f"no {row['doc_id']}")
        return str(len(row["text"] or ""))

    return callbacks.run_callback(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", work)


ORACLES["callback_runs"] = """SELECT CAST(doc_id AS VARCHAR) AS call_ref, CASE WHEN doc_id % 13 = 0 THEN 'error' ELSE 'returned' END AS status, CASE WHEN doc_id % 13 = 0 THEN 'ValueError: no ' || doc_id END AS error,
 CASE WHEN doc_id % 13 <> 0 THEN CAST(length(coalesce(text, '')) AS VARCHAR) END AS output FROM documents"""


@query
def callback_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    by_function = callbacks.counted(d, "text", lambda t: t.count(" ") + 1, "by_function")
    return callbacks.counted(callbacks.counted(by_function, "text", F.length("text"), "by_column"), "text", None, "estimated").drop("text")


ORACLES["callback_tokens"] = "SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS by_function, coalesce(length(text), 0) AS by_column, CAST(ceil(coalesce(strlen(text), 0) / 3) AS BIGINT) AS estimated FROM documents"


@query
def tool_context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context pack as the tool builds it from a vault's files."""
    folder = new_folder(spark, "vault")
    items.write_items(vault.serialized(adapters.memory_items(spark, sf_dir).drop("source_hash", "claim").withColumnRenamed("tags", "semantic_tags")), folder.removeprefix("file:"))
    return tools.build_context_pack(spark, folder, TASK, SCOPE)


ORACLES["tool_context_pack"] = ORACLES["context_pack"]
