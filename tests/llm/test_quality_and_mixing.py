"""The classifiers on held-out rows and the fit of the mixture against numpy."""

import random

import numpy as np
import pytest

from quarry.llm import mixing, quality


def corpus(n=400):
    random.seed(4)
    words = ["tree", "river", "stone", "cloud", "light", "house", "garden", "winter", "paper", "mountain", "of", "the", "and", "song"]
    docs, labels = [], []
    for i in range(n):
        w = [random.choice(words) + random.choice(["", "", "s", "ing", "ed"]) for _ in range(random.randint(30, 90))]
        good, toxic = i % 5 != 0, i % 7 == 0
        if not good:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        if toxic:
            w[3] = w[5] = "scum"
        docs.append((i, " ".join(w) + "."))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


@pytest.fixture
def tables(spark, documents):
    docs, labels = corpus()
    return documents([*docs, (9000, None), (9001, ""), (9002, docs[1][1]), (9002, docs[1][1])]), spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int"), dict((a, b) for a, b, _ in labels)


def test_quality_on_held_out_rows(tables):
    docs, labels, truth = tables
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= 0.95
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_column_and_matrix_agree(tables):
    docs, labels, _ = tables
    model = quality.train(docs, labels)
    assert model.rules
    stats = quality.with_statistics(docs).select(*[f"_s_{n}" for n in quality.NAMES], model.column().alias("x")).collect()
    data = np.array([list(r) for r in stats])
    assert np.allclose(model.matrix(data[:, :-1]), data[:, -1])


def test_quality_without_both_classes(tables):
    docs, labels, _ = tables
    assert all(r.predicted == 1 for r in quality.classify(docs, labels.limit(0)).collect())
    assert all(r.predicted == 0 for r in quality.classify(docs, labels.filter("quality = 0")).collect())
    assert quality.classify(docs.limit(0), labels).count() == 0


def test_rates_meet_the_targets(tables):
    docs, labels, _ = tables
    weights = {"good": 0.7, "good_toxic": 0.1, "low": 0.15, "low_toxic": 0.05}
    rows = mixing.mix(docs, labels, weights).collect()
    n = np.array([r.n_tokens for r in rows], float)
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    rate = np.array([r.rate for r in rows])
    assert np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    got = (n * rate) @ p / n.sum()
    assert np.allclose(got, [weights[d] for d in mixing.DOMAINS], atol=5e-3)
    # The same steps by hand.
    share, r = n @ p / n.sum(), np.ones(len(n))
    for _ in range(mixing.STEPS):
        miss = (n * r) @ p / n.sum() - np.array([weights[d] for d in mixing.DOMAINS])
        if np.abs(miss).max() < mixing.TOLERANCE:
            break
        r = np.maximum(0, r - (p @ (miss / share) + (r - 1) * mixing.PULL) / (1 + mixing.PULL))
    assert np.allclose(r, rate, atol=1e-5)


@pytest.mark.parametrize(("weights", "most"), [({"good": 0.5, "low": 0.15, "good_toxic": 0.27, "low_toxic": 0.08}, 1e-3), ({"good": 1.0}, 1)])
def test_overlapping_domains_reach_tolerance_or_minimum(spark, weights, most):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([6, 2, 4, 1.5], 600)
    n = rng.integers(20, 400, 600)
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n_tokens long, " + ", ".join(f"p_{d} double" for d in ("good", "low", "good_toxic", "low_toxic")))
    got, history = mixing.fit_rates(members, weights)
    names = list(mixing.DOMAINS)
    rows = got.collect()
    n, rate = np.array([r.n_tokens for r in rows]) / sum(r.n_tokens for r in rows), np.array([r.rate for r in rows])
    q = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    miss = (n * rate) @ q - np.array([weights.get(d, 0.0) for d in names])
    assert np.allclose(miss, [history[-1][d] for d in names], atol=1e-5)
    slope = q @ (miss / (n @ q)) + (rate - 1) * mixing.PULL
    assert np.abs(slope[rate > 0]).max() < 1e-4 and slope[rate == 0].min(initial=0) > -1e-4
    # The 40 gradient steps alone miss the first targets by 4.4e-3.
    assert np.abs(miss).max() < most


def test_posteriors_follow_the_labels(tables):
    docs, labels, truth = tables
    rows = mixing.mix(docs, labels, {"good": 1.0}).collect()
    held = [r for r in rows if r.doc_id in truth]
    right = sum((r.p_good + r.p_good_toxic > 0.5) == (truth[r.doc_id] == 1) for r in held)
    assert right / len(held) > 0.9


def test_mixing_edges(tables):
    docs, labels, _ = tables
    assert {r.rate for r in mixing.mix(docs, labels.limit(0), {"good": 1.0}).collect()} == {1.0}
    assert mixing.mix(docs.limit(0), labels, {"good": 1.0}).count() == 0
