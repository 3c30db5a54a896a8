"""Markdown vaults, JSON-lines logs, CSV tables and record collections as DataFrames, and their sinks."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.schemas import MEMORY_ITEM

KINDS = {"personal": "people", "project": "projects", "evidence": "notes", "session": "sessions"}
PART = 16 << 20
SKIPPED = ("agent", "reports", ".git", "node_modules")
FRONT = r"(?s)\A---\s*\n(.*?)\n---"
CLAIM = r"(?s)(?:^|\n)## Claim[ \t]*\n+(.*?)(?=\n## |\z)"


def markdown_files(spark: SparkSession, root: str, skip: tuple[str, ...] = SKIPPED, glob: str = "*.md") -> DataFrame:
    """path (below the root), content and length of every Markdown file, without those of skipped folders."""
    # Whole files as bytes: the text reader sets up much more for each file. Spark counts 4 MB for opening one, so a task gets few
    # small files; tasks are put together to about PART bytes.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = files.coalesce(max(4 * spark.sparkContext.defaultParallelism, -(-size // PART)))
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^[a-z]+:/*", "/")
    inner = F.substring_index(path, "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    rows = files.select(inner.alias("path"), F.col("content").cast("string").alias("content"), F.col("length").alias("bytes"))
    return rows.filter(~F.split("path", "/")[0].isin(*skip)) if skip else rows


def parse_items(files: DataFrame) -> DataFrame:
    """Items from the JSON front matter of files; the body's claim wins over the content. Unreadable files drop out."""
    item = F.from_json(F.regexp_extract("content", FRONT, 1), MEMORY_ITEM, {"mode": "PERMISSIVE"})
    claim = F.regexp_replace(F.regexp_extract("content", CLAIM, 1), r"^\s+|\s+$", "")
    # Behind the generator both are taken once, not again for each field.
    rows = files.select("path", F.inline(F.array(F.struct(item.alias("i"), claim.alias("claim"))))).filter("i is not null and i.id is not null")
    content = F.when(F.col("claim") != "", F.col("claim")).otherwise(F.col("i.content"))
    return rows.select("path", *[(content if f == "content" else F.col(f"i.{f}")).alias(f) for f in MEMORY_ITEM.fieldNames()])


def unreadable(files: DataFrame) -> DataFrame:
    """Files that ``parse_items`` drops, as rows of an error table."""
    return files.join(parse_items(files).select("path"), "path", "left_anti").select("path", F.lit("unreadable").alias("marker"))


def scope_files(items: DataFrame, scope: str) -> DataFrame:
    """Items whose scope contains the given one or whose file has its name."""
    return items.filter(F.col("scope").contains(scope) | F.col("path").endswith(f"/{scope}.md")).dropDuplicates(["id"])


def search_files(files: DataFrame, words: str, limit: int) -> DataFrame:
    """Files that contain a text, whatever the case, in the order of their paths."""
    return files.filter(F.lower("content").contains(words.lower())).orderBy("path").limit(limit)


def content_hashes(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.sha2("content", 256).alias("current_hash"), F.col("length").alias("bytes"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType, missing_ok: bool = True) -> DataFrame:
    """A JSON-lines log; a bad line is an error, a missing file an empty table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if missing_ok and not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def collection(spark: SparkSession, root: str, name: str, project_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{root}/{name}")
    return rows if project_id is None else rows.filter(F.col("project_id") == project_id)


def listed(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Records with their place in the listing of their project: by the digest of the id, as files are named by it."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.sha2(F.col(key).cast("string"), 256))))


def selected(rows: DataFrame, **conditions: object) -> DataFrame:
    """Rows that equal all given conditions; one that is None does not count."""
    for name, value in conditions.items():
        rows = rows if value is None else rows.filter(F.col(name) == value)
    return rows


def mixed_registry(**parts: DataFrame) -> DataFrame:
    """One view of several tables, by column names, with where each row comes from; columns that a table lacks are null."""
    named = [df.withColumn("origin", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def legacy_facts(files: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Facts of the verified personal items, and of project items of exactly this scope; and files that cannot be read."""
    rows = legacy_files(files, project)
    return rows.filter("state = 'fact'").drop("state"), rows.filter("state <> 'fact'").select(F.col("legacy_path").alias("path"), F.col("state").alias("code"))


def legacy_files(files: DataFrame, project: str) -> DataFrame:
    """The facts (state fact) and the files that cannot be read (state LEGACY_PARSE_ERROR), in one pass over the files.

    A file needs JSON front matter, an empty line and a body; its claim wins over the content, and may not be empty.
    """
    close = "\n---\n\n"
    at = F.when(F.startswith("content", F.lit("---\n")), F.locate(close, F.col("content"), 5))
    parts = files.select("path", F.inline(F.array(F.struct("content", at.alias("at")))))  # behind the generator each is taken once, not again for each field
    item = F.from_json(F.when(F.col("at") > 0, F.expr("substring(content, 5, at - 5)")), MEMORY_ITEM)
    body = F.expr(f"substring(content, at + {len(close)})")
    rows = parts.select("path", F.inline(F.array(F.struct(item.alias("i"), F.when(F.contains("content", F.lit("## Claim\n\n")), body).alias("body")))))
    claim = F.when(F.contains("body", F.lit("## Claim\n\n")), F.regexp_extract("body", r"(?s)## Claim\n\n(.*?)(?=\n## Metadata\n|\s*\z)", 1))
    wanted = (F.col("i.status") == "verified") & ((F.col("i.kind") == "personal") | ((F.col("i.kind") == "project") & (F.col("i.scope") == project)))
    parsed = F.col("i").isNotNull() & F.coalesce("i.id", "i.status", "i.kind", "i.content").isNotNull()
    chosen = rows.withColumn("parsed", parsed).filter(~F.col("parsed") | wanted)
    told = chosen.select("path", "i", "parsed", F.inline(F.array(F.struct(F.coalesce(F.regexp_replace(claim, r"\A\s+|\s+\z", ""), F.col("i.content")).alias("text")))))
    fact = F.col("parsed") & (F.coalesce("text", F.lit("")) != "")
    return told.withColumn("fact", fact).select(
        F.col("path").alias("legacy_path"), F.when(F.col("fact"), "fact").otherwise("LEGACY_PARSE_ERROR").alias("state"),
        F.when(F.col("fact"), F.coalesce("i.id", "path")).alias("memory_id"), F.when(F.col("fact"), F.when(F.col("i.kind") == "personal", "user").otherwise("project")).alias("kind"),
        F.when(F.col("fact") & (F.col("i.kind") == "project"), F.lit(project)).alias("project_id"), F.when(F.col("fact"), F.col("text")).alias("content"))


def chunked(rows: DataFrame, key: str, text: str, size: int = 1024) -> DataFrame:
    """The bytes of each text in chunks of fixed size, each with its digest."""
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.octet_length(text) / size).cast("int") - 1, F.lit(0)))
    cut = lambda raw: F.transform(numbers, lambda i: F.struct(i.alias("chunk_no"), F.substring(raw, i * size + 1, F.lit(size)).alias("body")))
    parts = F.transform(F.array(F.encode(text, "UTF-8")), cut)  # a text is encoded once, not for each of its chunks
    return rows.select(key, F.inline(parts[0])).withColumn("digest", F.sha2("body", 256))


def read_ranges(chunks: DataFrame, reads: DataFrame, key: str, size: int = 1024) -> DataFrame:
    """Bytes [start, stop) of each read (read_id, key, start, stop), put together from the chunks that it touches, and no others.

    ``intact`` tells whether all of these are there and still have their digests.
    """
    need = reads.filter("stop > start").select("read_id", key, "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / size).cast("int"), F.floor((F.col("stop") - 1) / size).cast("int"))).alias("chunk_no"))
    j = need.join(chunks, [key, "chunk_no"], "left")
    base = F.col("chunk_no") * size
    first = F.greatest(F.col("start") - base, F.lit(0)).cast("int")
    part = F.substring(F.col("body"), first + 1, F.least(F.col("stop") - base, F.lit(size)).cast("int") - first)
    good = F.coalesce(F.sha2("body", 256) == F.col("digest"), F.lit(False))
    got = j.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", part.alias("part")))).alias("parts"), F.bool_and(good).alias("intact"))
    empty = F.lit("").cast("binary")
    return got.select("read_id", F.aggregate("parts", empty, lambda a, p: F.concat(a, F.coalesce(p["part"], empty))).alias("body"), "intact")


def imported_traces(spark: SparkSession, source: str) -> DataFrame:
    """Trace files with their content and its digest, which is their id; files of the same content are one trace."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(source)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    ids = files.select(F.sha2("content", 256).alias("trace_id"), name.alias("file"), "path", F.col("length").alias("bytes"))
    # Only digests are grouped; the content of one file of each is fetched afterwards.
    one = ids.groupBy("trace_id").agg(F.min(F.struct("file", "path", "bytes")).alias("x"), F.count("*").alias("copies")).select("trace_id", "x.*", "copies")
    return files.select("path", "content").join(one, "path").select("trace_id", "file", "copies", "bytes", "content")


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Puts a text in the place of a file in one step: written beside it, closed, then renamed over it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid4().hex}.tmp")
    out = target.getFileSystem(conf).create(beside, False)
    try:
        out.write(bytearray(text.encode()))
        out.hsync()
    finally:
        out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, options)


def read_page(spark: SparkSession, root: str, page: str) -> DataFrame:
    """path and content of one page of a knowledge base; a path that leads out of its root is an error."""
    parts: list[str] = []
    for p in page.split("/"):
        if p == ".." and not parts:
            raise ValueError("a page must lie below the root of its knowledge base")
        parts = parts[:-1] if p == ".." else parts + [p] if p not in ("", ".") else parts
    if page.startswith("/") or not parts:
        raise ValueError("a page must lie below the root of its knowledge base")
    inner = "/".join(parts)
    return spark.read.text(f"{root.rstrip('/')}/{inner}", wholetext=True).select(F.lit(inner).alias("path"), F.col("value").alias("content"))


def resolved_config(general: dict, nearest: dict) -> dict:
    """A project's settings over the general ones; the knowledge bases of both, the general ones first."""
    bases = [*general.get("knowledgeBases", ()), *nearest.get("knowledgeBases", ())]
    return {**general, **nearest, "knowledgeBases": bases}


def nearest_config(start: str, name: str) -> dict:
    """The settings in the first file of this name in a folder or those above it, with its path; without one, none."""
    folder = Path(start).resolve()
    for at in (folder, *folder.parents):
        if (at / name).is_file():
            try:
                return {**json.loads((at / name).read_text("utf-8")), "projectConfigPath": str(at / name)}
            except ValueError:
                return {"projectConfigPath": str(at / name)}
    return {}


def verified_records(rows: DataFrame, payload: str = "payload", digest: str = "digest") -> DataFrame:
    """Records with whether their digest still is that of their payload."""
    return rows.withColumn("intact", F.sha2(payload, 256) == F.col(digest))


def typed_csv(spark: SparkSession, path: str, types: dict[str, str], empty_is_null: bool = True) -> DataFrame:
    """A CSV file by declared types; strings stay as they are, and an empty number is null (or an error)."""
    raw = spark.read.option("header", True).option("nullValue", "\0").option("emptyValue", "").option("escape", '"').csv(path, schema=", ".join(f"`{c}` string" for c in types))

    def typed(name: str, kind: str) -> Column:
        if kind == "string":
            return F.coalesce(F.col(name), F.lit(""))
        value = F.nullif(F.trim(name), F.lit("")) if empty_is_null else F.trim(name)
        return value.cast(kind)

    return raw.select(*[typed(c, k).alias(c) for c, k in types.items()])


def serialized(items: DataFrame) -> DataFrame:
    """Items as Markdown texts with JSON front matter, and the file that each belongs to."""
    fields = [c for c in MEMORY_ITEM.fieldNames() if c in items.columns]
    folder = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("kind")]
    text = F.concat(F.lit("---\n"), F.to_json(F.struct(*fields)), F.lit("\n---\n\n# "), F.col("id"), F.lit("\n\n## Claim\n\n"), F.col("content"), F.lit("\n"))
    return items.select(F.concat(folder, F.lit("/"), F.col("id"), F.lit(".md")).alias("path"), text.alias("content"))


def append_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def report_text(rows: DataFrame, section: str, line: str) -> DataFrame:
    """One Markdown section for each group, its lines sorted."""
    body = F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col(line)))))
    return rows.groupBy(section).agg(F.concat(F.lit("## "), F.first(section), F.lit("\n\n"), body).alias("text"))


def touched(retrievals: DataFrame, items: DataFrame) -> DataFrame:
    """Items with the counts and times that a table of retrieval events (id, at) adds; nothing is rewritten in place."""
    seen = retrievals.groupBy("id").agg(F.count_distinct("at").cast("int").alias("_n"), F.max("at").alias("_at"))
    j = items.join(seen, "id", "left")
    at = F.greatest("last_retrieved_at", "_at")
    return j.withColumns({"retrieval_count": F.coalesce("retrieval_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_retrieved_at": at, "updated_at": F.greatest("updated_at", "_at")}).drop("_n", "_at")


#: Parts of the folders that meet a config apart from each other.
SALTS = 16


def resolved_settings(folders: DataFrame, configs: DataFrame, general: dict[str, str], bases: list[str]) -> DataFrame:
    """For each folder the settings in the nearest config (folder, text as JSON) in it or above it, over the general ones.

    folder, config_folder (null: none), settings (text by name; what is no text is JSON) and bases, the general ones first. A
    config that cannot be read counts as one without settings.
    """
    parts = F.split("folder", "/")
    prefix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    above = folders.select("folder", F.posexplode(prefix).alias("depth", "at"))
    # Only numbers are aggregated for each folder, in a hash table: texts would be sorted, those of all folders of a task. A config far
    # up is that of most folders, so each config is met in SALTS parts of the folders.
    salt, salts = F.pmod(F.xxhash64("folder"), F.lit(SALTS)).cast("int").alias("salt"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    there = configs.select(F.col("folder").alias("at")).distinct().select("at", salts)
    deepest = above.select("*", salt).join(there, ["at", "salt"], "left_semi").groupBy("folder").agg(F.max("depth").alias("depth"))
    texts = configs.groupBy(F.col("folder").alias("at")).agg(F.max("text").alias("text")).select("at", "text", salts)
    near = deepest.select("folder", prefix[F.col("depth")].alias("at"), salt).join(texts, ["at", "salt"]).select("folder", F.struct("at", "text").alias("x"))
    own = F.from_json(F.col("x.text"), "map<string,string>")
    own_bases = F.from_json(F.get_json_object(F.col("x.text"), "$.knowledgeBases"), "array<string>")
    base = F.create_map(*[F.lit(x) for pair in general.items() for x in pair]) if general else F.create_map().cast("map<string,string>")
    known = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, v: k != "knowledgeBases")
    rest = F.map_filter(base, lambda k, v: ~F.map_contains_key(known, k))
    start = F.array(*map(F.lit, bases)) if bases else F.array().cast("array<string>")
    return folders.select("folder").join(near, "folder", "left").select(
        "folder", F.col("x.at").alias("config_folder"), F.map_concat(rest, known).alias("settings"), F.concat(start, F.coalesce(own_bases, F.array().cast("array<string>"))).alias("bases"))
