"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

Vectors are scaled into the unit ball and given one more coordinate that makes them unit vectors, so the largest inner
product is the smallest angle. Three rounds of random signs and a fast Hadamard transform turn them; the hash is the
nearest signed axis, and beyond a number of rows a second turn, limited to a few axes, splits the cells further. Each
of several tables is probed at the cells that a query comes closest to, and all candidates are reranked by the exact
inner product of the original vectors.

Equal vectors are searched as one and carry their smallest ids, of which no query can need more than k + 1, so a
vector that a third of all rows share is one candidate. Cells are dealt out in groups; a group with many rows is split,
with its queries sent to every part.

Defined results: vectors that are null, zero or hold null or non-finite components take no part; a shorter vector counts
as filled up with zeros; a query's own row (by vec_id) is no candidate; ties go to the smaller vec_id; a query with
fewer than k candidates found gets these; repeated rows are candidates of their own; very long vectors are read whole; a
product beyond double precision is infinite, and one without a value (infinities of both signs) ranks last; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quarry.llm.blocks import matrix, valid_vectors
from quarry.llm.common import keyed_runs, materialize

TABLES = 8
#: Probed cells of each table with the first 2 * width cells; more cells get more probes by this power.
PROBES, PROBE_POWER = 32, 0.8
ROWS_PER_CELL = 256
GROUP_CELLS = 16
PART_ROWS = 8192


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the width is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(-1, n)
        h *= 2
    return x / math.sqrt(n)


class Hashing:
    """Cells of unit vectors in every table. ``extra`` is the number of bits of the second turn."""

    def __init__(self, dims: int, tables: int, extra: int, probes: int, seed: int = 7):
        self.width = 1 << max(1, math.ceil(math.log2(dims + 1)))
        rng = np.random.default_rng(seed)
        self.signs = rng.choice([-1.0, 1.0], (tables, 2, 3, self.width))
        self.tables, self.probes = tables, probes
        self.axes = min(self.width, 1 << (extra - 1)) if extra else 0
        self.cells = 2 * self.width * max(1, 2 * self.axes)

    def turned(self, x: np.ndarray, table: int, which: int) -> np.ndarray:
        for s in self.signs[table, which]:
            x = hadamard(x * s)
        x = x if not which else x[:, : self.axes]
        return np.concatenate((x, -x), axis=1)

    def placed(self, x: np.ndarray, table: int) -> np.ndarray:
        cell = self.turned(x, table, 0).argmax(axis=1)
        if self.axes:
            cell = cell * 2 * self.axes + self.turned(x, table, 1).argmax(axis=1)
        return cell

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """The cells whose axes each vector comes closest to, best first."""
        first = self.turned(x, table, 0)
        if not self.axes:
            return np.argsort(-first, axis=1)[:, : self.probes]
        second = self.turned(x, table, 1)
        # Falling short of the best axis costs its square; the costs of both turns add up.
        a = (first.max(axis=1, keepdims=True) - first) ** 2
        b = (second.max(axis=1, keepdims=True) - second) ** 2
        cost = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
        most = min(self.probes, cost.shape[1])
        near = np.argpartition(cost, most - 1, axis=1)[:, :most]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(cost, near, 1), axis=1), 1)


def lifted(x: np.ndarray, width: int, top: float, largest: float, asks: bool) -> np.ndarray:
    """Unit vectors whose angles order the inner products of the originals. ``top`` is the largest component of all vectors,
    ``largest`` the norm of the longest one divided by it: what is squared is at most one."""
    out = np.zeros((len(x), width))
    x = x / (np.abs(x).max(axis=1, keepdims=True, initial=0) if asks else top)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    out[:, : x.shape[1]] = x / (norm if asks else largest)
    if not asks:
        out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / largest) ** 2))
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows with a vector, summed from the first component to the last."""
    with np.errstate(over="ignore", invalid="ignore"):
        return np.add.accumulate(a * b, axis=1)[:, -1] if a.shape[1] else np.zeros(len(a))


def nearest(ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best rows by exact inner product, ties to the smaller id."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = vectors @ q
    if len(ids) > k and np.isfinite(rough).all():  # infinite ones are equal, so their ids decide
        least = np.partition(rough, len(rough) - k)[len(rough) - k]
        keep = rough >= least - 1e-9 * (abs(least) + 1)
        ids, vectors = ids[keep], vectors[keep]
    score = in_order(vectors, q)
    best = np.lexsort((ids, -score))[:k]
    return ids[best], score[best]


def search(embeddings: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probes: int = PROBES, rows_per_cell: int = ROWS_PER_CELL) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id ``every`` divides."""
    # Components that come in single precision move in it, too; they are doubles again before they are multiplied.
    kind = embeddings.schema["embedding"].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    valid = valid_vectors(embeddings).filter(F.exists("vector", lambda x: x != 0))
    asks = F.col("vec_id") % every == 0
    # Equal vectors are one; the ids are thinned in two steps, so no task gets all rows of one vector.
    salted = Window.partitionBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    thin = valid.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= k + 1).drop("r")
    thin = thin.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    ids = thin.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = valid.filter(asks).select("vector").distinct().select(F.col("vector").alias("v"), F.lit(True).alias("asks"))
    one = ids.join(asked, F.col("vector") == F.col("v"), "left").select(F.col("ids")[0].alias("vid"), "ids", "vector", F.coalesce("asks", F.lit(False)).alias("asks"))
    one = materialize(one, "vectors")
    n, dims, top = one.agg(F.count("*"), F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    n, dims, top = n or 0, dims or 1, top or 1.0
    square = one.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / top) * (x / top)))).first()[0]
    largest = math.sqrt(square or 1.0) * (1 + 1e-12)
    width = 1 << max(1, math.ceil(math.log2(dims + 1)))
    extra = max(0, math.ceil(math.log2(max(n, 1) / (rows_per_cell * 2 * width))))
    extra = extra + 1 if extra == 1 else extra  # one axis gives two cells, two give four
    cells = 2 * width * (2 ** extra if extra else 1)
    hashing = Hashing(dims, tables, extra, math.ceil(probes * (cells / (2 * width)) ** PROBE_POWER))

    def place(batches):
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            x = matrix(whole.column("vector"), dims)
            vids, asking = whole.column("vid").to_numpy(), whole.column("asks").to_numpy()
            stored = lifted(x, width, top, largest, False)
            queries = lifted(x[asking], width, top, largest, True)
            vectors = whole.column("vector").combine_chunks().cast(pa.list_(pa.float32() if single else pa.float64()))
            where = np.flatnonzero(asking)
            for t in range(hashing.tables):
                cell = hashing.placed(stored, t)
                yield as_rows(t, cell // GROUP_CELLS, False, [[c] for c in cell.tolist()], vids, vectors)
                if len(where):
                    groups, lists, rows = [], [], []
                    for row, near in zip(where, hashing.probed(queries, t), strict=True):
                        group = near // GROUP_CELLS
                        for g in np.unique(group):
                            groups.append(int(g))
                            lists.append(near[group == g].tolist())
                            rows.append(row)
                    yield as_rows(t, np.array(groups), True, lists, vids[rows], vectors.take(pa.array(rows)))

    placed = materialize(one.select("vid", "vector", "asks").mapInArrow(place, "t int, g int, q boolean, cells array<int>, vid long, " + f"vector array<{'float' if single else 'double'}>"), "placed")
    parts = placed.filter("not q").groupBy("t", "g").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts"))
    dealt = placed.join(parts, ["t", "g"]).withColumn("part", F.explode(F.when(F.col("q"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")))))
    keys = ["t", "g", "part"]
    dealt = dealt.select(*keys, "q", "cells", "vid", "vector").repartition(*keys).sortWithinPartitions(*keys)

    def rerank(batches):
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for rows in keyed_runs(batches, keys):
            q = rows.column("q").to_numpy()
            if not q.any() or q.all():
                continue
            vids, vectors = rows.column("vid").to_numpy(), matrix(rows.column("vector"), dims)
            lists = rows.column("cells").to_pylist()
            held = np.flatnonzero(~q)
            cell = np.array([lists[i][0] for i in held])
            order = np.argsort(cell, kind="stable")
            held, cell = held[order], cell[order]
            for i in np.flatnonzero(q).tolist():
                near = np.array(sorted(lists[i]))
                spans = zip(np.searchsorted(cell, near, "left"), np.searchsorted(cell, near, "right"), strict=True)
                pick = [held[a:b] for a, b in spans if b > a]
                if not pick:
                    continue
                pick = np.concatenate(pick)
                found, score = nearest(vids[pick], vectors[pick], vectors[i], k + 1)
                old = best.get(int(vids[i]))
                if old is not None:
                    new = ~np.isin(found, old[0])
                    found, score = np.concatenate((old[0], found[new])), np.concatenate((old[1], score[new]))
                    top = np.lexsort((found, -score))[: k + 1]
                    found, score = found[top], score[top]
                best[int(vids[i])] = (found, score)
            if len(best) > 50_000:
                yield as_found(best)
                best = {}
        if best:
            yield as_found(best)

    found = dealt.mapInArrow(rerank, "query long, vid long, score double").dropDuplicates(["query", "vid"])
    ranked = Window.partitionBy("query").orderBy(F.isnan("score"), F.col("score").desc(), F.col("vid"))
    top = found.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1).join(one.select("vid", "ids"), "vid")
    listed = top.select("query", F.explode("ids").alias("vec_id"), "score")
    ranked = Window.partitionBy("query").orderBy(F.isnan("score"), F.col("score").desc(), F.col("vec_id"))
    listed = listed.withColumn("r", F.row_number().over(ranked)).filter(F.col("r") <= k + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    askers = valid.filter(asks).select(F.col("vec_id").alias("query_id"), "vector").join(one.filter("asks").select(F.col("vector").alias("v"), F.col("vid").alias("query")), F.col("vector") == F.col("v")).select("query_id", "query")
    own = askers.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def as_rows(t: int, groups: np.ndarray, q: bool, cells: list, vids: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    n = len(vids)
    return pa.RecordBatch.from_pydict({"t": pa.array([t] * n, pa.int32()), "g": pa.array(groups, pa.int32()), "q": pa.array([q] * n), "cells": pa.array(cells, pa.list_(pa.int32())), "vid": pa.array(vids, pa.int64()), "vector": vectors})


def as_found(best: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "query": pa.array(np.repeat(np.fromiter(best, np.int64, len(best)), [len(v[0]) for v in best.values()])),
        "vid": pa.array(np.concatenate([v[0] for v in best.values()])),
        "score": pa.array(np.concatenate([v[1] for v in best.values()])),
    })
