"""Vector searches against comparing all rows."""

import random

import numpy as np
import pytest

from quarry.llm import cross_polytope, exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0, 0) for i, v in rows], SCHEMA)


def sample(n=300, dims=8):
    random.seed(2)
    rows = [(i, [1.0, 2.0, 0.5] + [0.25] * (dims - 3) if i % 3 == 0 else [random.gauss(0, 1) for _ in range(dims)]) for i in range(n)]
    bad = [None, [0.0] * dims, [float("nan")] * dims, [None] + [1.0] * (dims - 1), [float("inf")] * dims, [3.0]]
    return rows + [(1000 + 100 * i, v) for i, v in enumerate(bad)]


def usable(rows, zero):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    width = max(len(v) for _, v in kept)
    return np.array([i for i, _ in kept]), np.array([[*map(np.float32, v), *[0.0] * (width - len(v))] for _, v in kept], float)


@pytest.mark.parametrize("block", [4, 128])
def test_exact_search(spark, monkeypatch, block):
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(exact_topk, "CHUNK_QUERIES", 4)
    rows = sample()
    ids, x = usable(rows, True)
    x = np.floor(256 * x).astype(np.int64)
    expected = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        expected |= {(int(ids[q]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)}
    assert {tuple(r) for r in exact_topk.search(vectors(spark, rows)).collect()} == expected


def whole(x):
    """floor(256 * x) as a Python integer."""
    from fractions import Fraction

    return int(Fraction(float(x)) * 256 // 1)


@pytest.mark.parametrize("power", [12, 20, 50, 120])
def test_exact_search_with_cancelling_terms(spark, monkeypatch, power):
    # Terms far larger than their sums, up to scores beyond 64 bits; small blocks and shards make the bounds matter.
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 1)
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 40)
    random.seed(power)
    rows = []
    for i in range(150):
        a = random.uniform(0.5, 1) * 2.0**power
        rows.append((i, [a, -a + random.randint(-40, 40), random.uniform(-30, 30), 2.0**power, float(random.randint(-3, 3))]))
    rows.append((0, rows[7][1]))  # a row that repeats a vec_id
    x = [(i, [whole(np.float32(c)) for c in v]) for i, v in rows]
    got = {}
    for r in exact_topk.search(vectors(spark, rows)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    limit = 2**63 - 1
    for q, v in [(i, v) for i, v in x if i % 50 == 0 and i]:
        near = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q))[:5]
        assert sorted(got[q]) == [(r + 1, i, max(-limit, min(limit, -s))) for r, (s, i) in enumerate(near)]


def test_blocks_are_pruned_where_vectors_have_structure(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(40, 16))
    rows = [(i, [float(c) for c in middle[i % 40] + 0.05 * rng.normal(size=16)]) for i in range(4000)]
    assert exact_topk.blocks_scored(vectors(spark, rows)) < 0.5


@pytest.mark.parametrize("cell", [256, 2])
def test_approximate_search_recall(spark, cell):
    rows = sample(dims=16)
    ids, x = usable(rows, False)
    got = {}
    for r in cross_polytope.search(vectors(spark, rows), rows_per_cell=cell).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r["rank"], r.score)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = np.add.accumulate(x * x[q], axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if j != q][:20]
        total += len(order)
        for j in order:
            if int(ids[j]) in got[ids[q]]:
                hits += 1
                assert got[ids[q]][int(ids[j])][1] == s[j]
    assert hits / total >= 0.9
    assert set(got) == {int(i) for i in ids if i % 20 == 0}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 64))
    assert np.allclose(np.linalg.norm(cross_polytope.hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)), x)


def test_empty_tables(spark):
    none = vectors(spark, []).limit(0)
    assert exact_topk.search(none).count() == 0 and exact_topk.blocks_scored(none) == 0 and cross_polytope.search(none).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_approximate_search_of_ties_and_repeated_rows(spark, kind):
    # Equal vectors, rows that repeat an id, and components that single precision cannot hold.
    rows = [(i, [1.0 + (i % 3) * 1e-9, 0.1, -0.2, 0.3]) for i in range(60)] + [(20, [1.0, 0.1, -0.2, 0.3]), (61, [0.5] * 4)]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    got = {}
    for r in cross_polytope.search(df, k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    cast = np.float32 if kind == "float" else np.float64
    x = [(i, np.array(list(map(cast, v)), float)) for i, v in rows]
    for q in {i for i, _ in x if i % 20 == 0}:
        asked = [v for i, v in x if i == q]  # each row of the id asks by itself
        scores = {float(np.add.accumulate(v * w)[-1]) for v in asked for i, w in x if i != q}
        assert len(got[q]) == 5 * len(asked) and all(i != q and s in scores for _, i, s in got[q])
        if len(asked) == 1:
            near = sorted((-float(np.add.accumulate(asked[0] * w)[-1]), i) for i, w in x if i != q)[:5]
            assert [(-s, i) for _, i, s in sorted(got[q])] == near


def test_exact_search_beyond_doubles(spark, monkeypatch):
    # Scores that no double holds, in several blocks, and components whose product with the scale is not finite.
    monkeypatch.setattr(exact_topk, "BLOCK_ROWS", 16)
    random.seed(6)
    rows = [(i, [random.choice([1e200, -1e200, 1.7e308, 3.0, 1e-200, 2.0**52 + 0.5]) * random.uniform(0.5, 1) for _ in range(6)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [(i, [whole(c) for c in v]) for i, v in rows]
    got = {}
    for r in exact_topk.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    limit = 2**63 - 1
    for q, v in [(i, v) for i, v in x if i % 50 == 0]:
        near = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in x if i != q))[:5]
        assert sorted(got[q]) == [(r + 1, i, max(-limit, min(limit, -s))) for r, (s, i) in enumerate(near)]


@pytest.mark.parametrize("power", [-170, 150, 155, 200, 307])
def test_approximate_search_of_any_size(spark, power):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16)) * 10.0**power
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in cross_polytope.search(df).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert set(got) == set(range(0, 300, 20)) and all(len(v) == 20 for v in got.values())
    if power < 150 and power > -150:
        return
    hits = 0
    unit = x / 10.0**power
    for q, found in got.items():
        score = unit @ unit[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20].tolist()) & set(found))
        with np.errstate(over="ignore", invalid="ignore"):
            assert all(np.array_equal(s, np.add.accumulate(x[q] * x[i])[-1], equal_nan=True) for i, s in found.items())
    # Where products are infinite or zero, they are equal, and ids decide among them.
    assert hits / 300 >= 0.9 or power in (-170, 155, 200, 307)


def test_names_that_clash(spark):
    names = "t int, g int, q boolean, cells int, vid long, shard int, chunk int, asks int, share double, query_id long"
    df = spark.createDataFrame([(i, [float(i % 7), 1.0], *([None] * 10)) for i in range(60)], "vec_id long, embedding array<float>, " + names)
    assert cross_polytope.search(df).count() == 60 and exact_topk.search(df).count() == 10
