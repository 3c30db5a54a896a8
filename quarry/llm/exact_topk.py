"""Exact top-k search by integer inner product, a block of documents at a time.

Documents and queries meet in the cells of a grid: each cell holds one shard of the documents and one chunk of the
queries, both of bounded size, so the stated queries are scored against all rows without a cross join. In a cell, the
documents lie in blocks of neighbouring vectors. For each query the terms' largest contributions in a block (by the
sign of the query's weight, the maximum or minimum of the component) are summed to a bound; blocks are taken by
falling bound and scored through their forward index until the next bound falls below the kth best score. The first
block thus sets the score that the others must reach. Where vectors have no structure, as with independent components,
the bounds of all blocks stay above it, and every block is scored; ``blocks_scored`` tells the share.

Defined results: a vector that is null or holds null or non-finite components takes no part; a shorter vector counts
as filled up with zeros, very long ones are read whole; a query's own row (by vec_id) is no candidate, nor is any other row with this vec_id; repeated rows are
candidates of their own; ties go to the smaller vec_id; a query without candidates has no row; a score beyond 64 bits is
given as the largest long of its sign but ranked by its exact value; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import best_rows, integers, matrix, valid_vectors

SHARD_ROWS = 16_384
CHUNK_QUERIES = 4_096
BLOCK_ROWS = 128
#: Products of integers below this, summed over a few thousand terms, are exact in double precision.
EXACT_IN_DOUBLE = 2**20
LARGEST_LONG = 2**63 - 1
#: No sum of products of doubles reaches this; as bytes, scores raised by it have this length.
BEYOND, KEY_BYTES = 1 << 2100, 264

CELL = pa.schema([("shard", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary()), ("share", pa.float64())])


def order_blocks(docs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """An order that puts like vectors side by side: by strongest term and its sign, then its weight."""
    if not docs.size:
        return np.argsort(ids, kind="stable")
    top = np.abs(docs).argmax(axis=1)
    weight = docs[np.arange(len(docs)), top]
    return np.lexsort((ids, -np.abs(weight), weight < 0, top))


def upper_bounds(docs: np.ndarray, queries: np.ndarray, starts: np.ndarray, slack: float) -> np.ndarray:
    """For each query the sum of the terms' largest contributions in each block; ``slack`` is the share of rounding a term."""
    high = np.maximum.reduceat(docs, starts, axis=0)
    low = np.minimum.reduceat(docs, starts, axis=0)
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    if slack:
        # Products are rounded, and may cancel: the bound must not fall short by more than their absolute sum allows.
        bounds += np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T * ((docs.shape[1] + 8) * slack)
    return bounds


def scaled(x: np.ndarray, scale: int) -> tuple[np.ndarray, int]:
    """floor(scale * x) divided by a power of two that keeps products far from overflow, and that power."""
    top = int(np.frexp(np.abs(x).max(initial=1.0))[1])
    power = max(0, top + 8 - 400)
    large = np.abs(x) >= 2.0**60  # whole already
    return np.where(large, np.ldexp(x * scale if top < 1000 else np.ldexp(x, -power), -power if top < 1000 else scale.bit_length() - 1), np.ldexp(np.floor(np.where(large, 0, x) * scale), -power)), power


def search_cell(ids: np.ndarray, docs: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, scale: int):
    """The k best documents of each query: query number, vec_ids, scores, share of the blocks scored."""
    n = len(ids)
    wide = max(np.abs(docs).max(initial=0), np.abs(queries).max(initial=0)) >= EXACT_IN_DOUBLE / scale
    order = order_blocks(docs, ids)
    ids, docs = ids[order], docs[order]
    starts = np.arange(0, n, BLOCK_ROWS)
    if wide:
        (small, a), (asked, b) = scaled(docs, scale), scaled(queries, scale)
        bounds, power = upper_bounds(small, asked, starts, 2.0**-52), a + b
        docs, queries = integers(docs, scale, 0), integers(queries, scale, 0)
    else:
        docs, queries = np.floor(docs * scale), np.floor(queries * scale)
        bounds = upper_bounds(docs, queries, starts, 0.0)
    by_bound = np.argsort(-bounds, axis=1, kind="stable")
    for q in range(len(query_ids)):
        scored = 0
        top_ids = np.empty(0, np.int64)
        top_scores = np.empty(0, object if wide else np.float64)
        kth = None
        for b in by_bound[q]:
            if kth is not None:
                # A scaled bound is compared among integers, rounded up, with one more for what was too small for a double.
                bound = (math.ceil(bounds[q, b]) + 1) << power if wide else bounds[q, b]
                if bound < kth:
                    break
            scored += 1
            at = starts[b]
            scores = docs[at : at + BLOCK_ROWS] @ queries[q]
            here = ids[at : at + BLOCK_ROWS]
            take = here != query_ids[q]
            if kth is not None:
                take &= (scores >= kth).astype(bool)
            if not take.any():
                continue
            top_ids = np.concatenate((top_ids, here[take]))
            top_scores = np.concatenate((top_scores, scores[take]))
            if len(top_ids) > k:
                best = np.lexsort((top_ids, -top_scores))[:k]
                top_ids, top_scores = top_ids[best], top_scores[best]
            if len(top_ids) >= k:
                kth = min(top_scores)
        yield q, top_ids, top_scores, scored / len(starts)


def order_key(score: int) -> bytes | None:
    """Bytes that sort as scores do, for those that a long cannot tell apart."""
    return (score + BEYOND).to_bytes(KEY_BYTES, "big") if abs(score) >= LARGEST_LONG else None


def grid(embeddings: DataFrame, every: int) -> DataFrame:
    """The rows of each cell (shard, chunk): documents once for each chunk of queries, queries once for each shard."""
    valid = valid_vectors(embeddings)
    n, nq = valid.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    shards, chunks = max(1, -(-n // SHARD_ROWS)), max(1, -(-nq // CHUNK_QUERIES))
    docs = valid.select(
        F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "vec_id", "vector",
    )
    asked = valid.filter(F.col("vec_id") % every == 0).select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"), "vec_id", "vector",
    )
    return docs.unionByName(asked)


def search_cells(embeddings: DataFrame, k: int, every: int, scale: int) -> DataFrame:
    """The best rows of each cell: shard, query_id, vec_id, score, beyond (the order of scores past a long), share."""

    def cell(key, rows):
        asks = rows.column("asks").to_numpy()
        ids = rows.column("vec_id").to_numpy()
        vectors = matrix(rows.column("vector"))
        out = []
        if asks.any() and not asks.all():
            query_ids = ids[asks]
            for q, found, scores, share in search_cell(ids[~asks], vectors[~asks], query_ids, vectors[asks], k, scale):
                for vec_id, score in zip(found.tolist(), map(int, scores), strict=True):
                    out.append((key[0].as_py(), int(query_ids[q]), vec_id, max(-LARGEST_LONG, min(LARGEST_LONG, score)), order_key(score), share))
        cols = zip(*out, strict=True) if out else [()] * len(CELL)
        return pa.table([pa.array(c, f.type) for c, f in zip(cols, CELL, strict=True)], schema=CELL)

    return grid(embeddings, every).groupBy("shard", "chunk").applyInArrow(cell, "shard int, query_id long, vec_id long, score long, beyond binary, share double")


def search(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id ``every`` divides, over all other rows."""
    found = search_cells(embeddings, k, every, scale)
    return best_rows(found.withColumn("part", (F.col("shard") / 64).cast("int")), k, "part", "beyond")


def blocks_scored(embeddings: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> float:
    """The share of blocks that were scored, over all queries and cells."""
    return search_cells(embeddings, k, every, scale).dropDuplicates(["shard", "query_id"]).agg(F.avg("share")).first()[0] or 0.0
