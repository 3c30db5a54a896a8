"""The audit against applying the filters one after the other."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from quarry.llm import filter_audit

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1 and d is not None} for k in (0, 1))
    smallest = {}
    for d, t, _ in rows:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    docs = []
    for d, t, source in rows:
        text = t or ""
        words = WORDS.findall(text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": d is not None and smallest[text] < d,
        }
        docs.append((source or "", d, {f for f, x in fails.items() if x}))
    out, removals = [], Counter()
    for part in {p for p, _, _ in docs}:
        mine = [(d, f) for p, d, f in docs if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                removals[part, f] += len(gone)
                out.append((part, order, step, len(left), len(gone), sum(f in x[1] for x in mine) - len(gone), sum(x[1] == {f} for x in mine), sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)))
    return sorted((*r, removals[r[0], r[1][r[2] - 1]]) for r in out)


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "en", 1, 2, 3) for r in rows], "doc_id long, text string, source string, lang string, part int, mask int, quality int")
    known = spark.createDataFrame([(*x, "y", 0) for x in labels], "doc_id long, quality int, toxic int, part string, n int")
    return sorted(tuple(r) for r in filter_audit.audit(docs.repartition(3), known).collect())


def sample():
    random.seed(8)
    texts = ["", None, " \t\n", "A" * 5, "#", "é " * 60, "word " * 50, " ".join(map(str, range(50))), " ".join(map(str, range(49))), "x\x0by\x1cz " * 20, "A" + "b" * 19, "AB" + "c" * 38 + "d", " ".join(["a"] * 35 + [f"w{i}" for i in range(64)])]
    texts += [" ".join(random.choice(["Alpha", "beta", "#", "g", "É"]) for _ in range(random.choice([3, 49, 50, 51, 120]))) for _ in range(30)]
    rows = [(i, random.choice(texts), random.choice(["s", "t", None, ""])) for i in range(400)]
    rows += [(i, "one text of a third of all rows", "hot") for i in range(1000, 1300)] + [(None, "", "s"), (None, None, "u"), (5, "#", "s"), (5, "#", "s"), (-3, "#", "t")]
    labels = [(i, random.choice([0, 1, None]), random.choice([0, 1, None])) for i in range(0, 1300, 3)] + [(6, 1, 0), (6, 0, 1), (None, 1, 1), (99999, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("ranges", ["2", "7", "64"])
def test_every_order(spark, ranges):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows, labels = sample()
        assert found(spark, rows, labels) == plain(rows, labels)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_that_share_a_fingerprint(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *a: F.lit(7).cast("long"))
    rows, labels = sample()
    assert found(spark, rows, labels) == plain(rows, labels)


def test_empty_and_long(spark):
    rows, labels = [(1, "word #B " * 300_000, "s"), (2, "word #B " * 300_000, "s"), (3, "Q" * 1_000_000, None)], []
    assert found(spark, rows, labels) == plain(rows, labels)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.limit(0), known).count() == 0
