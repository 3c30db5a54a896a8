"""Compression of vectors to codes: each part of a vector becomes the index of the nearest entry of its codebook.

Components become integers, so distances, codebooks and errors are exact. The nearest entry is found by lower bounds:
the segment-mean bound of two vectors is, summed over blocks, the block's length times the squared difference of the block
means, plus the squared difference of the norms of what the means leave. It starts with one block a part and halves the
blocks; entries whose bound is above the least upper bound drop out at each level, with a margin for rounding, and only
the survivors get their exact integer distance. Spark sums the parts of each entry in the tasks and then over the tasks;
only codebooks and these sums reach the driver, and both are bounded by the parameters.

Defined results: a vector that is null or holds null or non-finite components takes no part, nor does a row whose vec_id
is null; vectors of other lengths than a multiple of the number of parts, and shorter ones, count as filled up with zeros;
long ones are read whole; fewer vectors than entries give fewer entries; rows that repeat a vec_id count each (as first
entries, in the order of their vectors); equal distances go to the lower index; an entry that no part chose stays;
components of any finite size are exact, and an error or sum of errors beyond 64 bits is given as the largest long; an
empty table gives an empty table; of other columns only label is read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import integers, matrix
from quarry.llm.common import BROADCAST_IDS, materialize, small_batches

#: Sums of squares of differences stay below 2^62 for integers up to this, over parts of up to 256 components.
EXACT = 2**26
#: Share of the squared lengths by which bounds and distances in double precision may be off, and more.
MARGIN = 1e-12
LARGEST_LONG = 2**63 - 1
#: Vectors that are assigned together.
BATCH_ROWS = 1024
#: Bits of the limbs in which sums travel: sums of limbs over many tasks stay within a long.
LIMB = 32


def block_means(m: np.ndarray, block: int) -> np.ndarray:
    """By column: means of blocks of ``block`` components (the last may be shorter), each times the root of its length, and the norm of the rest.

    The squared distance of two such rows is the segment-mean bound of the vectors.
    """
    at = np.arange(0, m.shape[1], block)
    sizes = np.diff([*at, m.shape[1]])
    means = np.add.reduceat(m, at, axis=1) / sizes
    rest = np.sqrt(np.square(m - np.repeat(means, sizes, axis=1)).sum(axis=1))
    return np.vstack(((means * np.sqrt(sizes)).T, rest))


def squared(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of pairs of rows, given by column."""
    out = 0
    for x, y in zip(a, b, strict=True):
        difference = x[at] - y[to]
        out = out + difference * difference
    return out


def first_least(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs in the order of their rows ``at``: the place of the first least value of each row, and these values."""
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    if values.dtype == object:
        least = np.array([min(values[a:b]) for a, b in zip(starts, [*starts[1:], len(at)], strict=True)], dtype=object)
    else:
        least = np.minimum.reduceat(values, starts)
    hits = np.flatnonzero(values == least[at])
    return hits[np.flatnonzero(np.diff(at[hits], prepend=-1))], least


def nearest(part: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``part`` the index of the nearest entry, the lowest among equals, and the exact squared distance."""
    n, width = part.shape
    rows = np.arange(n)
    cut_off = 0.0
    if part.dtype == object or entries.dtype == object:  # bounds are taken of shifted values, whose squares are finite
        largest = max(int(np.abs(part).max(initial=0)), int(np.abs(entries).max(initial=0)), 1)
        shift = max(0, largest.bit_length() - 60)
        x, e = (np.array([float(int(v) >> shift) for v in m.ravel()]).reshape(m.shape) for m in (part, entries))
        cut_off = 2.0 if shift else 0.0  # the most that the shift takes off a difference, with room
    else:
        x, e = part.astype(np.float64), entries.astype(np.float64)
    reach = np.square(x).sum(axis=1) + np.square(e).sum(axis=1).max(initial=0)
    margin = MARGIN * reach + cut_off * (4 * np.sqrt(width * reach) + 4 * width)
    xs, es = np.ascontiguousarray(x.T), np.ascontiguousarray(e.T)
    # The coarsest level meets all entries; at each level the entry of the lowest bound gives a row an upper bound.
    mean_x, mean_e = block_means(x, width), block_means(e, width)
    bound = np.square(mean_x[0][:, None] - mean_e[0]) + np.square(mean_x[1][:, None] - mean_e[1])
    most = squared(xs, rows, es, bound.argmin(axis=1)) + 2 * margin
    at, entry = np.nonzero(bound <= most[:, None])
    block = -(-width // 2)
    while 1 < block < width and len(at) > 2 * n:
        bound = squared(block_means(x, block), at, block_means(e, block), entry)
        most = np.minimum(most, squared(xs, rows, es, entry[first_least(at, bound)[0]]) + 2 * margin)
        open_ = bound <= most[at]
        at, entry = at[open_], entry[open_]
        block = -(-block // 2) if block > 2 else 1
    place, least = first_least(at, squared(np.ascontiguousarray(part.T), at, np.ascontiguousarray(entries.T), entry))
    return entry[place], least


def encode(vectors: np.ndarray, codebooks: list[np.ndarray], scale: int):
    """Per part: the integer components, the chosen entries and the squared distances."""
    width = codebooks[0].shape[1]
    whole = integers(vectors, scale, EXACT)
    for i, entries in enumerate(codebooks):
        part = whole[:, i * width : (i + 1) * width]
        yield (part, *nearest(part, entries))


def limbs(value: int) -> list[int]:
    """Signed parts of LIMB bits, lowest first."""
    out, sign = [], -1 if value < 0 else 1
    value = abs(value)
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def entry_sums(vectors: DataFrame, codebooks: list[np.ndarray], scale: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> the number of its parts and the sums of their components, for the entries that any part chose."""
    width = codebooks[0].shape[1]
    # A column of sums for each component and one of ones, which counts.
    schema = "part int, entry int, at int, limb int, value long"

    def run(batches):
        sums: dict[tuple[int, int], list[int]] = {}
        for batch in small_batches(batches, BATCH_ROWS):
            for i, (part, entry, _) in enumerate(encode(matrix(pa.chunked_array([batch.column(0)]), width * len(codebooks)), codebooks, scale)):
                order = np.argsort(entry, kind="stable")
                starts = np.flatnonzero(np.diff(entry[order], prepend=-1))
                counted = np.column_stack((part, np.ones(len(part), part.dtype)))[order]
                for e, row in zip(entry[order][starts].tolist(), np.add.reduceat(counted, starts, axis=0).tolist(), strict=True):
                    held = sums.get((i, e))
                    sums[i, e] = row if held is None else [a + b for a, b in zip(held, row, strict=True)]
        rows = [(i, e, at, k, v) for (i, e), row in sums.items() for at, total in enumerate(row) for k, v in enumerate(limbs(total))]
        columns = zip(*rows, strict=True) if rows else [()] * 5
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "entry", "at", "limb", "value"])

    out: dict[tuple[int, int], list[int]] = {}
    for r in vectors.select("vector").mapInArrow(run, schema).groupBy("part", "entry", "at", "limb").agg(F.sum("value").alias("value")).collect():
        out.setdefault((r.part, r.entry), [0] * (width + 1))[r["at"]] += r.value << (LIMB * r.limb)
    return {key: (row[-1], row[:-1]) for key, row in out.items()}


def compact(entries: list[list[int]], width: int) -> np.ndarray:
    """Entries of one codebook; Python integers where 64 bits may not be enough."""
    largest = max((abs(v) for row in entries for v in row), default=0)
    return np.array(entries, dtype=np.int64 if largest < EXACT else object).reshape(len(entries), width)


def fit(vectors: DataFrame, parts: int, entries: int, rounds: int, scale: int) -> list[np.ndarray]:
    """The codebook of each part, after ``rounds`` of assigning and averaging, started from the smallest vec_ids."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // parts)
    first = vectors.orderBy("vec_id", "vector").limit(entries).collect()
    start = integers(np.array([[*r.vector, *[0.0] * (width * parts - len(r.vector))] for r in first], float).reshape(len(first), width * parts), scale, EXACT)
    codebooks = [compact(start[:, i * width : (i + 1) * width].tolist(), width) for i in range(parts)]
    for _ in range(rounds if width else 0):
        sums = entry_sums(vectors, codebooks, scale)
        codebooks = [
            compact([[v // sums[i, e][0] for v in sums[i, e][1]] if (i, e) in sums else row for e, row in enumerate(book.tolist())], width)
            for i, book in enumerate(codebooks)
        ]
    return codebooks


def codes(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """vec_id, code (two hexadecimal digits for each part), error, label_error and the digest of all codebooks."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~bad)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("vector"))
    books = fit(rows.select("vec_id", "vector"), parts, entries, rounds, scale)
    digest = hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()
    width = books[0].shape[1]

    def run(batches):
        for batch in small_batches(batches, BATCH_ROWS):
            n = batch.num_rows
            code, error = np.zeros((n, parts), np.uint8), [0] * n
            if width:
                for i, (_, entry, distance) in enumerate(encode(matrix(pa.chunked_array([batch.column("vector")]), width * parts), books, scale)):
                    code[:, i] = entry
                    error = [a + b for a, b in zip(error, distance.tolist(), strict=True)]
            digits = code.tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([digits[2 * parts * i : 2 * parts * (i + 1)] for i in range(n)], pa.string()), pa.array([min(x, LARGEST_LONG) for x in error], pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    coded = materialize(rows.mapInArrow(run, "vec_id long, label string, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST_LONG).cast("decimal(38,0)")).cast("long")
    sums = coded.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "label_of")
    # Few labels are sent to every task; many are left to Spark's join, which splits hot ones.
    few = sums.limit(BROADCAST_IDS // 10 + 1).count() <= BROADCAST_IDS // 10
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("label_of")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
