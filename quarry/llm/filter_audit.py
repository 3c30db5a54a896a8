"""What each of a set of document filters removes, in every order of applying them.

A row's failures are a mask of bits, one for each filter. Four filters look at the text alone; the fifth fails texts that
a smaller doc_id has too, anywhere in the table. For it the rows are sorted by ranges of (fingerprint, doc_id), so that a
group of copies of any size spreads over tasks, and within each task by (fingerprint, text, doc_id): a row whose
predecessor has its text is a copy if the first doc_id of that run is smaller. A run may begin in an earlier range. So
each task also puts out the first rows of its first fingerprint and those of its last one, which are few, and a join of
both settles the former. Masks are then counted by part and labels, and as every count of every order is a sum over masks,
the 120 orders cost nothing but their rows.

Defined results: a null text counts as empty, a null source as the empty string; an empty text has no words, which fails
A and none of B, C, D; a row whose doc_id is null is no copy and makes none, and has no labels; rows that repeat a doc_id
count each, and are no copies of each other; of rows of labels that repeat a doc_id one that says so is enough; long texts
are judged whole; bounds are met exactly, in integers; a part has its rows even where all is zero; an empty table gives an
empty table; of other columns none is read.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import BROADCAST_IDS, materialize, small_batches

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COPY = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
SYMBOLS = re.compile(rb"[#$%&*|]")
FOLLOWING_BYTES = bytes(range(0x80, 0xC0))

#: A row of a document; a row that may continue a run of an earlier task; the head of a run that a later task may continue.
SETTLED, OPEN, HEAD = 0, 1, 2
MARKED = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("fingerprint", pa.int64()), ("text", pa.binary())])


def failures(text: bytes) -> int:
    """The mask of the filters that look at the text alone; words are parted by ASCII white space."""
    words = text.split()
    n = len(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, FOLLOWING_BYTES))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (SYMBOLS.search(text) is not None) << 3


def marked(docs: DataFrame) -> DataFrame:
    """One row for each document with its mask, copies within a task included, and the rows that settle runs across tasks."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("fingerprint", F.xxhash64("text"))
    # Rows that are alike in both keys spread by where they come from.
    ranged = rows.repartitionByRange("fingerprint", "doc_id", F.monotonically_increasing_id())
    ordered = ranged.select("doc_id", "part", F.col("text").cast("binary").alias("text"), "fingerprint").sortWithinPartitions("fingerprint", "text", F.col("doc_id").asc_nulls_last())

    def run(batches):
        first = fingerprint = text = head = mask = None
        heads: list[tuple] = []  # of the runs of the present fingerprint
        for batch in small_batches(batches):
            if not batch.num_rows:
                continue
            ids, prints = batch.column("doc_id").to_pylist(), batch.column("fingerprint").to_pylist()
            texts = batch.column("text")
            same = np.zeros(len(ids), bool)  # as the predecessor in this batch
            same[1:] = pc.equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
            if first is None:
                first = prints[0]
            kinds, masks, kept = [], [], []
            for i, doc_id in enumerate(ids):
                if prints[i] != fingerprint:
                    fingerprint, text, heads = prints[i], None, []
                if text is None or not (same[i] if i else texts[0].as_py() == text):
                    text, head = texts[i].as_py(), doc_id
                    mask = failures(text)
                    if head is not None:
                        heads.append((fingerprint, text, head))
                # The head's id is the least of the run here; rows with that id have no smaller one here.
                copied = doc_id is not None and head < doc_id
                reaches = fingerprint == first and doc_id is not None and not copied
                kinds.append(OPEN if reaches else SETTLED)
                masks.append(mask | (COPY if copied else 0))
                kept.append(text if reaches else None)
            prints_kept = [p if t is not None else None for p, t in zip(prints, kept, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int8()), batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(prints_kept, pa.int64()), pa.array(kept, pa.binary())], schema=MARKED)
        for of, text, least in heads:
            yield pa.RecordBatch.from_pydict({"kind": [HEAD], "doc_id": [least], "part": [None], "mask": [0], "fingerprint": [of], "text": [text]}, schema=MARKED)

    return ordered.mapInArrow(run, "kind byte, doc_id long, part string, mask int, fingerprint long, text binary")


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each document."""
    found = materialize(marked(docs), "marked")
    settled = found.filter(F.col("kind") == SETTLED).select("doc_id", "part", "mask")
    heads = found.filter(F.col("kind") == HEAD).groupBy("fingerprint", "text").agg(F.min("doc_id").alias("least"))
    opened = found.filter(F.col("kind") == OPEN).join(heads, ["fingerprint", "text"], "left")
    copied = F.when(F.col("least") < F.col("doc_id"), COPY).otherwise(0)
    return settled.unionByName(opened.select("doc_id", "part", F.col("mask").bitwiseOR(copied).alias("mask")))


def counted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Numbers of documents by part and mask: all, of good quality, toxic."""
    known = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    known = known.filter("good > 0 or toxic > 0").select("doc_id", (F.col("good") > 0).alias("good"), (F.col("toxic") > 0).alias("toxic"))
    few = known.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    rows = masks(docs).join(F.broadcast(known) if few else known, "doc_id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def bits(letters: Column) -> Column:
    """The mask of the filters that a string names."""
    out = F.lit(0)
    for i, letter in enumerate(FILTERS):
        out = out + F.when(letters.contains(letter), 1 << i).otherwise(0)
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step."""
    everything = (1 << len(FILTERS)) - 1

    def passing(name: str) -> Column:
        """For each set of filters, the documents of a part that fail none of them."""
        return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(name)).otherwise(0)) for s in range(everything + 1)])

    parts = counted(docs, labels).groupBy("part").agg(*[passing(n).alias(f"pass_{n}") for n in ("n", "good", "toxic")])
    step = F.posexplode(F.array(*map(F.lit, ORDERS)))
    rows = parts.select("*", step.alias("at", "filter_order")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    rows = rows.withColumn("own", bits(F.expr("substr(filter_order, step, 1)"))).withColumn("before", bits(F.expr("substr(filter_order, 1, step - 1)")))

    def left(name: str, of: Column) -> Column:
        return F.get(F.col(f"pass_{name}"), of)

    before, after, own = F.col("before"), F.col("before") + F.col("own"), F.col("own")
    removed = left("n", before) - left("n", after)
    # A filter comes right after a given set of s others in s! (4 - s)! of the orders.
    shapley = sum(
        F.when(own.bitwiseAND(s) == 0, (left("n", F.lit(s)) - left("n", own.bitwiseOR(s))) * (factorial(s.bit_count()) * factorial(len(FILTERS) - 1 - s.bit_count()) if s != everything else 0)).otherwise(0)
        for s in range(everything + 1)
    )
    return rows.select(
        "part", "filter_order", "step", left("n", after).alias("kept"), removed.alias("removed"),
        (left("n", F.lit(0)) - left("n", own) - removed).alias("redundant"),
        (left("n", F.lit(everything) - own) - left("n", F.lit(everything))).alias("unique_fails"),
        (left("good", before) - left("good", after)).alias("good_lost"), (left("toxic", before) - left("toxic", after)).alias("toxic_lost"),
        shapley.cast("long").alias("shapley"),
    )
