"""Repeated-string removal against counting every string."""

import hashlib
import random
from collections import Counter

import pytest

from quarry.llm import suffix_dedup as S


def covered(rows, span):
    """For each row the bytes that strings found anywhere else too cover."""
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[i : i + span] for i in range(len(b) - span + 1))
    for _, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if seen[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        yield b, gone


def brute(rows, span, passage):
    out = []
    for (d, _), (b, gone), (_, more) in zip(rows, covered(rows, span), covered(rows, passage)):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), sum(more)))
    return sorted(out, key=str)


def sample():
    random.seed(1)
    letters = lambda n, s="abc de": "".join(random.choice(s) for _ in range(n))
    p, q = letters(900), letters(450)
    rows = [(i, letters(random.randint(0, 300)) + (p[random.randint(0, 200) :] if i % 2 else q) + letters(50, "abcé")) for i in range(60)]
    return [*rows, (100, None), (101, ""), (102, "a" * 3000), (103, "ab" * 900), (104, "x" * 399), (105, "y" * 400), (106, "y" * 400), (107, p + p), (108, "é" * 300)]


@pytest.mark.parametrize(("spread", "piece"), [(1000, 1 << 18), (5, 1 << 18), (0, 1 << 18), (1000, 1024)])
def test_matches_brute_force(documents, monkeypatch, spread, piece):
    monkeypatch.setattr(S, "SPREAD", spread)
    monkeypatch.setattr(S, "GROUP", 2 if spread < 1000 else 500)
    monkeypatch.setattr(S, "PIECE", piece)
    rows = sample()
    got = sorted((tuple(r)[:6] for r in S.dedup(documents(rows), passage=S.PASSAGE, keep_text=True, carry=("lang", "n")).collect()), key=str)
    assert got == brute(rows, S.SPAN, S.PASSAGE)


def test_levels_find_what_one_batch_finds(monkeypatch):
    rows = [(d, t.encode()) for d, t in sample() if t]
    found = []
    for size in (10_000, 7):
        family, held = S.LevelFamily(), []
        for d, b in rows:
            for span, *arrays in S.entries(b, (S.SPAN, S.PASSAGE)):
                for gram, start, n, anchor in zip(*(x.tolist() for x in arrays)):
                    held.append(S.Entry(span, gram, gram, d * 10**6 + start, b[start:anchor], b[anchor : start + n + span - 1]))
                    if len(held) == size:
                        family.add(held)
                        held = []
        family.add(held)
        found.append(sorted((e.fp, e.span, e.places()) for e in family.results()))
    assert found[0] == found[1]
    assert len(family.levels) > 1


def test_rows_of_one_id_are_rows_of_their_own(documents):
    random.seed(3)
    a, b, c = ("".join(random.choice("abcdef ") for _ in range(1000)) for _ in range(3))
    rows = [(1, a), (1, b), (2, a), (None, b + "x"), (None, c), (3, c), (4, c + "y" * 50), (5, c), (5, c)]
    got = sorted((tuple(r) for r in S.dedup(documents(rows), passage=S.PASSAGE).collect()), key=str)
    assert got == brute(rows, S.SPAN, S.PASSAGE)
    rows = [(1, a), (1, b), (2, a), (7, c), (7, c)]
    got = sorted((tuple(r) for r in S.dedup(documents(rows), passage=S.PASSAGE).collect()), key=str)
    assert got == brute(rows, S.SPAN, S.PASSAGE)
    assert sorted(r[2] for r in got) == [0, 1000, 1000, 1000, 1000]


def test_long_texts(documents):
    random.seed(4)
    a = "".join(random.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, a), (2, "y" + a[300_000:300_399]), (3, "z" + a[300_000:300_400]), (4, a[262_000:262_500])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in S.dedup(documents(rows)).collect()}
    assert got == {1: (900, 2), 2: (0, 0), 3: (400, 1), 4: (500, 1)}


def test_empty_table(documents):
    assert S.dedup(documents([(1, "a")]).limit(0)).count() == 0
