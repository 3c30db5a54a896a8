"""The similarity join and its components against comparing all pairs."""

import random

import numpy as np
import pytest

from quarry.llm import ngram_join as N
from quarry.llm.components import connected_components
from quarry.llm.text_words import Shingler


def brute(rows, width, num, den):
    sh = Shingler(width)
    sets = {d: set(sh.shingles(t).tolist()) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and both * den >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


def sample():
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    base = [random.choice(words) for _ in range(120)]
    common = [f"c{i}" for i in range(30)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(random.randint(0, 6)):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((i, " ".join(w)))
    for i in range(90, 140):
        rows.append((i, " ".join([*common, *(random.choice(words) for _ in range(random.randint(0, 4)))])))
    long = [random.choice(words) + str(i % 7) for i in range(1500)]
    rows += [(200, " ".join(long)), (201, " ".join([*long[:-20], "x"])), (202, " ".join(long[200:]))]
    return [*rows, (300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "One"), (305, "one two"), (306, "ΣÄ one"), (307, "σä one")]


@pytest.mark.parametrize(("width", "num", "frequent"), [(3, 90, 64), (3, 90, 3), (5, 80, 10)])
def test_matches_all_pairs(documents, monkeypatch, width, num, frequent):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    rows = sample()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.join_groups(documents(rows), width, num, 100).collect()}
    assert got == brute(rows, width, num, 100)


@pytest.mark.parametrize(("width", "num", "frequent", "block", "large"), [(3, 90, 64, 256, 32), (3, 90, 3, 4, 3), (5, 80, 10, 3, 2), (3, 90, 3, 16, 1000)])
def test_finds_all_links(documents, monkeypatch, width, num, frequent, block, large):
    for name, value in (("FREQUENT", frequent), ("BLOCK", block), ("PAIR_BLOCK", block), ("LARGE", large), ("COLUMNS", 64)):
        monkeypatch.setattr(N, name, value)
    rows = [*sample(), (310, sample()[0][1]), (311, sample()[0][1])]
    sh = Shingler(width)
    sets = {d: frozenset(sh.shingles(t).tolist()) for d, t in rows}
    reps = {}
    for d in sorted(sets):
        reps.setdefault(sets[d], d)
    near = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) * 100 >= num * len(sets[a] | sets[b])}
    join = N.Join(documents(rows), width, num, 100)
    heads = set(reps.values())
    links = join.links().collect()
    assert {(r.a, r.b): pytest.approx(r.similarity) for r in links} == {k: v for k, v in near.items() if set(k) <= heads and v < 1}
    assert len(links) == len({(r.a, r.b) for r in links})
    assert {r.doc_id: r.n_links for r in join.groups().collect()} == {d: sum(d in k for k in near) for d in sets}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in join.groups().collect()} == brute(rows, width, num, 100)


def test_large_groups_become_cells(documents, monkeypatch):
    monkeypatch.setattr(N, "LARGE", 8)
    join = N.Join(documents(sample()), 3, 90, 100)
    assert join.members is not None and join.members.count() > 50
    # What leaves a cell grows with its members, not with its pairs.
    members = {r.v for r in join.members.select("v").collect()}
    assert join.in_cells(False).count() <= join.members.count() * -(-len(members) // N.BLOCK) < join.links().count()


def test_rows_of_one_id_are_rows_of_their_own(documents):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(1, near), (1, "x y z"), (2, "x y z"), (3, near + " 1"), (None, near + " 2"), (4, "x y z"), (2, "x y z"), (None, "alone it is")]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.n_links) for r in N.join_groups(documents(rows), 3, 90, 100).collect())
    assert got == sorted([(1, 24, 1, 2), (1, 1, 1, 3), (2, 1, 1, 3), (2, 1, 1, 3), (4, 1, 1, 3), (3, 25, 1, 2), (0, 25, 1, 2), (0, 1, None, 0)])


def test_long_texts_and_ties(documents):
    long = [f"w{i}" for i in range(40_000)]
    assert {r.component_id for r in N.join_groups(documents([(1, " ".join(long)), (2, " ".join(long[300:]))]), 3, 90, 100).collect()} == {1}
    # 900 of 1000 shingles are 90 per cent, 899 are not.
    exact = [(1, " ".join(long[:1002])), (2, " ".join(long[:902])), (3, " ".join(long[1002:2004])), (4, " ".join(long[1002:1903])), (5, "A b c"), (6, "a B\tc")]
    got = {r.doc_id: r.component_id for r in N.join_groups(documents(exact), 3, 90, 100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}


def test_empty_table(documents):
    assert N.join_groups(documents([(1, "a")]).limit(0), 3, 90, 100).count() == 0


@pytest.mark.parametrize(("num", "frequent"), [(90, False), (90, True), (80, True)])
def test_alike_sets_share_an_entry(num, frequent):
    rng = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(2, 260), dtype=np.uint64))
        b = np.unique(np.concatenate((rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.8, 1)))], rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64))))
        hot = np.sort(a[rng.random(len(a)) < 0.9]) if frequent else np.empty(0, np.uint64)
        both = len(np.intersect1d(a, b))
        if len(a) != both and both * 100 >= num * (len(a) + len(b) - both):
            p = N.Prefixes(num, 100, hot)
            assert np.isin(p.entries(a), p.entries(b)).any()


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 3), (7, 7), (4, 5), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (None, 3)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {2: 1, 3: 1, 9: 1, 5: 4} | {i: 20 for i in range(21, 26)}


def test_entries_are_counted_where_they_meet(spark, monkeypatch):
    monkeypatch.setattr(N, "materialize", lambda df, name: df)
    rows = spark.createDataFrame([(7, 1, 5), (7, 2, 6), (8, 1, 5), (9, 3, 5), (9, 4, 5), (9, 5, 5)], "entry long, v long, n long")
    found = N.shared_rows(rows)
    assert sorted(map(tuple, found.collect())) == [(7, 1, 5, 2), (7, 2, 6, 2), (9, 3, 5, 3), (9, 4, 5, 3), (9, 5, 5, 3)]
    # One read of the rows: before, they were read for their counts too, and joined.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and "Join" not in plan
