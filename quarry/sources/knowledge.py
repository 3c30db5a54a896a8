"""Search over knowledge bases: two kinds of HTTP services, then the files."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from quarry.functions import text as T
from quarry.sources import vault

HITS = "base string, query string, rank int, path string, title string, excerpt string, source string"
# Where the two kinds of services answer, and the fields that their hits may have.
PROJECT_SEARCH, PLAIN_SEARCH = "/api/v1/projects/current/search", "/search"
LISTS = ("tokenHits", "vectorHits", "results")
PATHS, TEXTS = ("path", "file"), ("excerpt", "snippet", "content")


class Asked(InputPartition):
    def __init__(self, base: str, api: str, query: str):
        self.base, self.api, self.query = base, api, query


def answer(request: urllib.request.Request, timeout: float) -> object | None:
    """The JSON of an answer; None for an error, another status or another text."""
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read().decode("utf-8")) if 200 <= reply.status < 300 else None
    except (OSError, ValueError):
        return None


def project_hits(api: str, query: str, limit: int, timeout: float) -> list | None:
    """Hits of a project service: those by token, by vector, and others, one list after the other. No hits count as no answer."""
    body = json.dumps({"query": query, "limit": limit}).encode()
    found = answer(urllib.request.Request(urllib.parse.urljoin(api, PROJECT_SEARCH), body, {"Content-Type": "application/json"}, method="POST"), timeout)
    if isinstance(found, dict):
        found = [hit for name in LISTS for hit in found.get(name) or []]
    return found if isinstance(found, list) and found else None


def plain_hits(api: str, query: str, limit: int, timeout: float) -> list | None:
    """Hits of a plain service; an empty list is an answer."""
    found = answer(urllib.request.Request(urllib.parse.urljoin(api, PLAIN_SEARCH) + "?" + urllib.parse.urlencode({"query": query, "limit": limit})), timeout)
    if isinstance(found, dict):
        found = found.get("results")
    return found if isinstance(found, list) else None


def first_text(hit: dict, names: tuple[str, ...]) -> str | None:
    return next((str(hit[n]) for n in names if hit.get(n) is not None), None)


class HitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.limit, self.timeout = int(options["limit"]), float(options.get("timeout", "10"))
        self.asked = [Asked(b["name"], b["api"], q) for b in json.loads(options["bases"]) for q in json.loads(options["queries"])]

    def partitions(self) -> list[InputPartition]:
        return self.asked

    def read(self, asked: Asked) -> Iterator[tuple]:
        for source, hits in (("project", project_hits), ("plain", plain_hits)):
            found = hits(asked.api, asked.query, self.limit, self.timeout)
            if found is not None:
                kept = [h for h in found if isinstance(h, dict) and first_text(h, PATHS)][: self.limit]
                for rank, h in enumerate(kept, 1):
                    path = first_text(h, PATHS)
                    yield asked.base, asked.query, rank, path, first_text(h, ("title",)) or path.rsplit("/", 1)[-1], first_text(h, TEXTS), source
                yield asked.base, asked.query, 0, None, None, None, source
                return
        yield asked.base, asked.query, 0, None, None, None, "none"


class KnowledgeSearch(DataSource):
    """Hits of each base and query; a row of rank 0 tells which service answered."""

    @classmethod
    def name(cls) -> str:
        return "knowledge_search"

    def schema(self) -> str:
        return HITS

    def reader(self, schema: StructType) -> HitReader:
        return HitReader(dict(self.options))


def search(spark: SparkSession, bases: list[dict], queries: list[str], limit: int, timeout: float = 10.0) -> DataFrame:
    """Hits by base and query. bases: name, and api and root or one of them; without an answer the files below root are searched."""
    spark.dataSource.register(KnowledgeSearch)
    served = [b for b in bases if b.get("api")]
    options = {"bases": json.dumps(served), "queries": json.dumps(queries), "limit": str(limit), "timeout": str(timeout)}
    rows = spark.read.format("knowledge_search").options(**options).load().cache() if served else spark.createDataFrame([], HITS)
    out = rows.filter("rank > 0")
    silent = {(r.base, r["query"]) for r in rows.filter("rank = 0 and source = 'none'").select("base", "query").collect()}
    for b in bases:
        for q in queries:
            if b.get("root") and (not b.get("api") or (b["name"], q) in silent):
                out = out.unionByName(file_hits(spark, b, q, limit))
    return out


def file_hits(spark: SparkSession, base: dict, query: str, limit: int) -> DataFrame:
    found = vault.search_files(vault.markdown_files(spark, base["root"]), query, limit)
    rank = F.row_number().over(Window.orderBy("path"))  # over ``limit`` rows at most
    return found.select(
        F.lit(base["name"]).alias("base"), F.lit(query).alias("query"), rank.alias("rank"), "path", T.title(F.col("content"), F.col("path")).alias("title"),
        T.keyword_excerpt(F.col("content"), query).alias("excerpt"), F.lit("files").alias("source"),
    )
