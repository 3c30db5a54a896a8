"""Codes of vectors against comparing all entries among Python integers."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest

from quarry.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, error long, code string, part int, entry int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "", 0, 0) for r in rows], SCHEMA)


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [(i, v, label) for i, v, label in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    width = -(-max(len(v) for _, v, _ in kept) // parts)
    whole = [[int(Fraction(x) * 256 // 1) for x in v] + [0] * (width * parts - len(v)) for _, v, _ in kept]
    cut = [[w[p * width : (p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign(p):
        out = []
        for c in cut:
            d = [sum((a - b) ** 2 for a, b in zip(c[p], e)) for e in books[p]]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        for p in range(parts):
            chosen = assign(p)
            for e in range(len(books[p])):
                own = [c[p] for c, (to, _) in zip(cut, chosen) if to == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    final = [assign(p) for p in range(parts)]
    most = vector_codes.LARGEST_LONG
    errors = [min(most, sum(final[p][r][1] for p in range(parts))) for r in range(len(kept))]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = min(most, by_label.get(label, 0) + e)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{final[p][r][0]:02x}" for p in range(parts)), errors[r], by_label[label], digest) for r, (i, _, label) in enumerate(kept))


def found(df):
    return sorted(tuple(r) for r in vector_codes.codes(df).collect())


@pytest.mark.parametrize("dims,power", [(64, 0), (16, 0), (37, 0), (48, 30), (32, 500), (17, 900)])
def test_codes_are_exact(spark, dims, power):
    random.seed(dims + power)
    rows = [(i, [random.gauss(0, 1) * 2.0**power for _ in range(dims)], random.choice([None, 1, 2])) for i in range(200)]
    rows += [(300 + i, rows[i][1], 3) for i in range(20)]  # ties: entries that are equal
    rows += [(None, rows[0][1], 1), (501, None, 1), (502, [float("nan")] * dims, 1), (503, [None] * dims, 1), (504, [float("inf")] * dims, None), (505, [1.5, -2.5], 1), (7, rows[9][1], 1), (506, [], None), (507, [1e-170] * dims, 2)]
    assert found(table(spark, rows)) == plain(rows)


def test_one_odd_value_among_many(spark):
    random.seed(1)
    rows = [(i, [random.gauss(0, 1) for _ in range(16)], 0) for i in range(100)] + [(200, [1.7e308, -1.7e308] * 8, 0), (201, [2.0**44 + 0.25] * 16, 1)]
    assert found(table(spark, rows)) == plain(rows)


def test_few_rows(spark):
    assert found(table(spark, [(1, [0.5] * 16, 0)]).limit(0)) == []
    for rows in ([(5, [0.5] * 16, 0)], [(5, [], None)], [(1, [0.1] * 20, 0), (2, [0.9] * 20, 0), (3, [0.5] * 20, None)]):
        assert found(table(spark, rows)) == plain(rows)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 8, 17])
def test_bounds_keep_the_nearest(width):
    rng = np.random.default_rng(width)
    part, entries = (rng.integers(-50, 50, size=(n, width)) for n in (300, 64))
    entries[9] = entries[4]
    entry, least = vector_codes.nearest(part, entries)
    distance = np.square(part[:, None, :] - entries).sum(axis=2)
    assert (entry == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
