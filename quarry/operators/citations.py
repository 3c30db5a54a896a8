"""Checking what nested drafts cite against what their packets provide."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lists that hold citations, the list of further requests, and the reasons.
CITATIONS = ("evidence_refs", "supporting_refs", "counterevidence_refs", "boundary_refs")
REQUESTS = "read_requests"
NOT_PROVIDED, NOT_READABLE = "original body not provided", "not an available unread catalog entry"
UNREADABLE = "draft is not JSON"


class Literal(str):
    """A number as it is written."""


def fields(pairs: list[tuple]) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a field is there twice")
    return found


def refuse(name: str):
    raise ValueError(name)


#: What Spark's parse_json takes: no repeated fields, no NaN; what follows the value does not count.
DECODER = json.JSONDecoder(object_pairs_hook=fields, parse_int=Literal, parse_float=Literal, parse_constant=refuse)


def text(value: object) -> str:
    """JSON with its numbers as they were written."""
    if isinstance(value, Literal):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{text(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(text, value)) + "]" if isinstance(value, list) else json.dumps(value)


def walk(draft: str) -> Iterator[tuple[str, str, object]]:
    """(path, kind, reference) of each citation and request of a draft."""
    try:
        waiting = [("$", None, DECODER.raw_decode(draft.lstrip(" \t\r\n"))[0])]
    except (ValueError, RecursionError):
        yield "$", "unreadable", None
        return
    while waiting:
        path, key, value = waiting.pop()
        if isinstance(value, dict):
            waiting += [(f"{path}.{k}", k, v) for k, v in value.items() if isinstance(v, (dict, list))]
        elif isinstance(value, list) and key in CITATIONS:
            yield from ((f"{path}[{i}]", "citation", v) for i, v in enumerate(value))
        elif isinstance(value, list) and key == REQUESTS:
            yield from ((f"{path}[{i}]", "request", v.get("ref_id") if isinstance(v, dict) else None) for i, v in enumerate(value))
        elif isinstance(value, list):
            waiting += [(f"{path}[{i}]", None, v) for i, v in enumerate(value) if isinstance(v, (dict, list))]


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, paths, kinds, refs, raws = [], [], [], [], []
        for i, draft in enumerate(batch.column(1).to_pylist()):
            for path, kind, ref in walk(draft):
                plain = isinstance(ref, str) and not isinstance(ref, Literal)
                at.append(i)
                paths.append(path)
                kinds.append(kind)
                refs.append(ref if plain else None)
                raws.append(None if plain or ref is None else text(ref))
        columns = [pa.array(c, pa.string()) for c in (paths, kinds, refs, raws)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], ["draft_id", "path", "kind", "ref_id", "raw"])


def cited(drafts: DataFrame) -> DataFrame:
    """Each citation and request of drafts (draft_id, draft as JSON): draft_id, path, kind, ref_id.

    A draft is parsed and walked once. Lists of citations and requests are taken whole and not walked further; a field of such
    a name that is no list is walked like any other. References that are no strings are put into words by Spark.
    """
    rows = drafts.filter("draft is not null").select("draft_id", "draft")
    found = rows.mapInArrow(walked, f"draft_id {rows.schema['draft_id'].dataType.simpleString()}, path string, kind string, ref_id string, raw string")
    return found.select("draft_id", "path", "kind", F.coalesce("ref_id", F.try_variant_get(F.try_parse_json("raw"), "$", "string")).alias("ref_id"))


def citation_errors(drafts: DataFrame, provided: DataFrame, readable: DataFrame) -> DataFrame:
    """draft_id, path, ref_id and reason of each citation that its packet does not provide, and of each request that is not
    for an available reference that was not provided. provided, readable: draft_id, ref_id."""
    has = provided.select("draft_id", "ref_id").distinct().withColumn("provided", F.lit(True))
    can = readable.select("draft_id", "ref_id").distinct().withColumn("readable", F.lit(True))
    rows = cited(drafts).join(has, ["draft_id", "ref_id"], "left").join(can, ["draft_id", "ref_id"], "left")
    given, open_ = F.coalesce("provided", F.lit(False)), F.coalesce("readable", F.lit(False))
    reason = F.when((F.col("kind") == "citation") & ~given, NOT_PROVIDED).when((F.col("kind") == "request") & (~open_ | given), NOT_READABLE).when(F.col("kind") == "unreadable", UNREADABLE)
    return rows.withColumn("reason", reason).filter("reason is not null").select("draft_id", "path", "ref_id", "reason")
