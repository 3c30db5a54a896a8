"""Similarity join of documents by the Jaccard similarity of their word n-grams, with token-combination prefixes.

A document's tokens are its distinct n-grams, in one order for all: rare tokens first, frequent ones last, each class by
fingerprint. Of n tokens a partner may lack t = floor(n * (1 - threshold)), so the first token that two partners share
is among the first t + 1 of either. If it is rare, it is indexed singly. If it is frequent, so are all tokens that they
share, and the prefix is extended: among its first t + s + 1 tokens are at least s + 1 shared ones. Tokens fall into s
segments by fingerprint, so two shared tokens fall into the same one, and pairs of frequent tokens of one segment are
indexed. s grows with the size of the set in steps of a factor of two, so the pairs stay a small multiple of t; a set
near a step is indexed for both. Frequent tokens are those in more prefixes than a bound that keeps their list small.

Equal sets make one class, for which a vertex stands. Classes that share an entry are candidates; they are checked by
size and by a parity bitmap, whose Hamming distance never exceeds the number of tokens in one set only, then by the
sets themselves. Small entries give their pairs. A large entry, which large groups of near copies make, takes one of its
classes as hub: 1 - similarity is a metric, so whoever is linked to a class of the hub's core (linked to the hub) is
within twice the distance of the hub. These neighbours form the hub's cell, one for all entries with this hub; the core
leaves the entry, which gets its next hub. In a cell, sets meet in blocks of bounded size, as matrix products, and
only numbers of links and one edge to the hub for each class come out, never the pairs. A link that several cells hold
counts in the first of them alone.

``join_groups`` returns the number of links and the component of each document; ``join_links`` lists the links between
classes, which for a large group of near copies are as many as its pairs. A document's number of links counts all other
documents that are similar enough, those with an equal set among them.

Defined results: null, empty and white-space texts have no tokens and are linked with nothing; fewer words than n make
one token; very long texts are read whole, each set in the memory of one task; rows that repeat a doc_id are rows of
their own, whatever their texts; a null doc_id counts as no id, so the smallest other one of its component is given, or
null; similarities at the threshold are links; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import discard, few_ids, keyed_runs, materialize, small_batches
from quarry.llm.components import connected_components
from quarry.llm.text_words import A, Shingler, mix

#: A token in more prefixes than this is frequent; the bound is doubled until at most so many tokens are.
FREQUENT, MOST_FREQUENT = 64, 250_000
#: Classes of an entry beyond which a hub takes its part; the rows that a round of hubs must take away, as a share.
LARGE, ROUND_SHARE = 32, 0.2
#: Classes of one cell, and of one size in a large entry, that a block holds.
BLOCK, PAIR_BLOCK = 256, 1024
#: Bits of the smallest bitmap.
BITS = 512
#: Bits of an entry that move: others that are equal in them too are candidates more, which the check drops.
ENTRY = (1 << 48) - 1
#: Tokens in the columns of one matrix product.
COLUMNS = 8192


class Prefixes:
    """The index entries of a set, for a threshold of num / den."""

    def __init__(self, num: int, den: int, frequent: np.ndarray):
        self.num, self.den, self.frequent = num, den, frequent

    def missing(self, n: int) -> int:
        return n * (self.den - self.num) // self.den

    def linkable(self, n: int) -> bool:
        """Whether a different set can be a partner."""
        return n * self.den >= self.num * (n + 1) or self.missing(n) > 0

    def levels(self, n: int) -> range:
        """The steps of the sizes from the smallest partner's up to n."""
        return range((-(-n * self.num // self.den)).bit_length(), n.bit_length() + 1)

    def segments(self, level: int) -> int:
        return max(1, self.missing(1 << (level - 1)) // 4)

    def ordered(self, s: np.ndarray, most: int) -> tuple[np.ndarray, int]:
        """The first tokens in the common order and the number of rare ones among them."""
        if not len(self.frequent):
            return s[:most], min(most, len(s))
        at = np.searchsorted(self.frequent, s)
        at[at == len(self.frequent)] = 0
        hot = self.frequent[at] == s
        rare = s[~hot]
        if len(rare) >= most:
            return rare[:most], most
        return np.concatenate((rare, s[hot][: most - len(rare)])), len(rare)

    def entries(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n or not self.linkable(n):
            return np.empty(0, np.uint64)
        t = self.missing(n)
        tokens, rare = self.ordered(s, t + self.segments(n.bit_length()) + 1)
        if rare >= t + 1:
            return tokens[: t + 1]
        out = [tokens[:rare]]
        if n - t <= self.segments(n.bit_length()):  # so few tokens in common that two of a segment are not certain
            out.append(tokens[rare : t + 1])
        for level in self.levels(n):
            parts = self.segments(level)
            hot = tokens[rare : t + parts + 1]
            segment = mix(hot + A) % np.uint64(parts)
            order = np.argsort(segment, kind="stable")
            hot, segment = hot[order], segment[order]
            for x in np.split(hot, np.flatnonzero(np.diff(segment)) + 1):
                i, j = np.triu_indices(len(x), 1)
                out.append(mix(mix(x[i] + A * np.uint64(level)) ^ x[j]))
        return np.unique(np.concatenate(out))


def parity_bits(s: np.ndarray) -> np.ndarray:
    """A bitmap, as 64-bit words, in which each token flips one bit; it has at least as many bits as tokens."""
    size = BITS
    while size < len(s):
        size *= 2
    odd = (np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def folded(bits: str, words: Column) -> Column:
    """A bitmap at half its size if it is longer than so many words: its halves added."""
    halves = F.zip_with(F.slice(bits, F.lit(1), words), F.slice(bits, words + 1, words), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > words, halves).otherwise(F.col(bits))


def distance(a: str, b: str) -> Column:
    """Hamming distance of two bitmaps whose sizes are equal or differ by a factor of two."""
    words = F.least(F.size(a), F.size(b))
    differ = F.zip_with(folded(a, words), folded(b, words), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and a fingerprint of the text, which tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def frequent_tokens(docs: DataFrame, width: int, num: int, den: int) -> np.ndarray:
    """Tokens in the prefixes of more than FREQUENT documents, or of the least multiple that keeps the list short.

    Which tokens are frequent only changes the order and the kind of the index entries, never what they find.
    """
    plain = Prefixes(num, den, np.empty(0, np.uint64))

    def run(batches):
        shingler = Shingler(width)
        for batch in small_batches(batches):
            sets = [shingler.shingles(x.as_py()) for x in batch.column(1)]
            firsts = [s[: plain.missing(len(s)) + 1] for s in sets if len(s) and plain.linkable(len(s))]
            if firsts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts).view(np.int64))], ["token"])

    counts = docs.mapInArrow(run, "token long").groupBy("token").count().filter(F.col("count") > FREQUENT)
    whole = counts = materialize(counts, "frequent")
    bounds = [FREQUENT << i for i in range(48)]
    over = counts.agg(*[F.count_if(F.col("count") > x) for x in bounds]).first()
    counts = counts.filter(F.col("count") > next(x for x, n in zip(bounds, over, strict=True) if n <= MOST_FREQUENT))
    got = counts.select("token").toArrow().column("token").to_numpy().view(np.uint64)
    discard(whole)
    return np.sort(got)


def prints(s: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


def index_rows(docs: DataFrame, width: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n, fingerprints, bitmap and index entries of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT numbers

    def run(batches):
        shingler = Shingler(width)
        prefixes = Prefixes(num, den, shared.value)
        for batch in small_batches(batches):
            sets = [shingler.shingles(x.as_py()) for x in batch.column(1)]
            marks = [prints(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "text_hash": batch.column(2),
                "n": pa.array(map(len, sets), pa.int64()),
                "f1": pa.array([m[0] for m in marks], pa.int64()),
                "f2": pa.array([m[1] for m in marks], pa.int64()),
                "bits": pa.array([parity_bits(s) for s in sets], pa.list_(pa.int64())),
                "entries": pa.array([prefixes.entries(s).view(np.int64) for s in sets], pa.list_(pa.int64())),
            })

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, f1 long, f2 long, bits array<long>, entries array<long>")


def alike(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and bitmaps (n, bits with the suffixes given) allow the similarity."""
    na, nb = F.col(f"n{a}"), F.col(f"n{b}")
    comparable = F.greatest(F.size(f"bits{a}"), F.size(f"bits{b}")) <= 2 * F.least(F.size(f"bits{a}"), F.size(f"bits{b}"))
    return sizes_allow(na, nb, num, den) & (~comparable | (distance(f"bits{a}", f"bits{b}") * (den + num) <= (na + nb) * (den - num)))


def sizes_allow(a: Column, b: Column, num: int, den: int) -> Column:
    return F.least(a, b) * den >= F.greatest(a, b) * num


def token_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fingerprints of the set, and the tokens themselves."""

    def run(batches):
        shingler = Shingler(width)
        for batch in small_batches(batches):
            sets = [shingler.shingles(x.as_py()) for x in batch.column(1)]
            marks = [prints(s) for s in sets]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "f1": pa.array([m[0] for m in marks], pa.int64()),
                "f2": pa.array([m[1] for m in marks], pa.int64()),
                "tokens": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
            })

    return docs.mapInArrow(run, "doc_id long, f1 long, f2 long, tokens array<long>")


class Sets:
    """The sets of chosen vertices, made again from the texts. ``classes`` is given if doc_ids don't tell sets apart."""

    def __init__(self, docs: DataFrame, width: int, again: bool, classes: DataFrame | None):
        self.docs, self.width, self.again, self.classes = docs, width, again, classes

    def of(self, vertices: DataFrame) -> DataFrame:
        """v, tokens"""
        if self.classes is None:
            texts = self.docs.join(few_ids(vertices.select(F.col("v").alias("doc_id"))), "doc_id", "left_semi")
            texts = texts.dropDuplicates(["doc_id"]) if self.again else texts
            return token_sets(texts, self.width).select(F.col("doc_id").alias("v"), "tokens")
        wanted = self.classes.join(vertices, "v", "left_semi").select("f1", "f2", "v")
        return token_sets(self.docs, self.width).join(wanted, ["f1", "f2"]).dropDuplicates(["v"]).select("v", "tokens")


def near_pairs(pairs: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps allow the similarity."""
    one = meta.select(F.col("v").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    two = meta.select(F.col("v").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    return pairs.join(one, "a").join(two, "b").filter(alike("1", "2", num, den)).select("a", "b")


def verified(pairs: DataFrame, sets: Sets, num: int, den: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: a, b, i (tokens in common), m (tokens of both)."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "candidate-ids")
    held = materialize(sets.of(ids), "candidate-sets")
    left = held.select(F.col("v").alias("a"), F.col("tokens").alias("x"))
    right = held.select(F.col("v").alias("b"), F.col("tokens").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("i"), (F.size("x") + F.size("y")).cast("long").alias("m"))
    out = materialize(both.filter(F.col("i") * den >= (F.col("m") - F.col("i")) * num), name)
    discard(held)
    discard(ids)
    return out


def shared_rows(rows: DataFrame) -> DataFrame:
    """Rows (entry, v, n) of entries with several classes and the number of these."""
    # Each class has an entry once, so one entry is a small part of all rows: they are counted where they meet, and move once.
    out = rows.withColumn("c", F.count("*").over(Window.partitionBy("entry"))).filter("c > 1")
    return materialize(out.select("entry", "v", "n", "c"), "shared-entries")


def with_hubs(rows: DataFrame) -> DataFrame:
    """Adds to the rows of large entries the hub of each: the class with the most such rows.

    The more of what is common a class has, the nearer it is to the middle of its group.
    """
    middle = rows.join(rows.groupBy("v").agg(F.count("*").alias("times")), "v")
    return rows.join(middle.groupBy("entry").agg(F.min(F.struct(-F.col("times"), "v")).getField("v").alias("hub")), "entry")


def entry_pairs(rows: DataFrame, meta: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a < b) of rows (entry, c, v, n) with a common entry whose sizes, in large entries bitmaps, allow a link.

    Pairs of a small entry are few, and are told by size before the bitmaps move. In a large one, sets meet those of like
    size only, and where these are still many in blocks, each two of which meet under a key of their own.
    """
    small = rows.filter(F.col("c") <= LARGE)
    one = small.select("entry", F.col("v").alias("a"), F.col("n").alias("n1"))
    two = small.select("entry", F.col("v").alias("b"), F.col("n").alias("n2"))
    few = one.join(two, "entry").filter("a < b").filter(sizes_allow(F.col("n1"), F.col("n2"), num, den)).select("a", "b").distinct()
    few = near_pairs(few, meta, num, den)
    # In steps of this factor, sizes that allow a link are at most one step apart.
    step = F.floor(F.log("n") / (math.log(den / num) * (1 + 1e-6))).cast("int")
    rows = rows.filter(F.col("c") > LARGE).select("entry", "v").join(meta, "v").withColumn("step", step)
    lower = rows.withColumn("k", F.col("step"))
    upper = rows.withColumn("k", F.explode(F.array("step", F.col("step") - 1)))
    blocks = lambda x, name: x.groupBy("entry", "k").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias(name))
    parts = blocks(lower, "lowers").join(blocks(upper, "uppers"), ["entry", "k"])
    part = lambda n: F.pmod(F.xxhash64("v"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lower = lower.join(parts, ["entry", "k"]).select("entry", "k", part("lowers").alias("i"), every("uppers").alias("j"), F.col("v").alias("a"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    upper = upper.join(parts, ["entry", "k"]).select("entry", "k", "step", part("uppers").alias("j"), every("lowers").alias("i"), F.col("v").alias("b"), F.col("n").alias("n2"), F.col("bits").alias("bits2"))
    met = lower.join(upper, ["entry", "k", "i", "j"]).filter("step > k or a < b").filter(alike("1", "2", num, den))
    return few.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()


def take_hubs(found: DataFrame, meta: DataFrame, sets: Sets, num: int, den: int) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """The members (hub, v, core) of all cells, the rows (entry, c, v, n) whose pairs are left, and the tables behind these.

    A round ends with the members of the core gone from their entries. A link of one of these is in the hub's cell,
    since its partner was in the entry too. When a round takes too few away, the rest is left as it is.
    """
    wide = max(2 * num - den, 0)  # twice the distance
    left, cells, made = [found.filter(F.col("c") <= LARGE)], [], [found]
    rows = found.filter(F.col("c") > LARGE)
    many = rows.count()
    while many:
        rows = materialize(with_hubs(rows), "hubs")
        stars = rows.filter("hub <> v").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct()
        stars = materialize(near_pairs(stars, meta, wide, den), "stars")
        near = verified(stars, sets, wide, den, "near")
        discard(stars)
        made.append(near)
        cells.append(near.select(F.col("a").alias("hub"), F.col("b").alias("v"), (F.col("i") * den >= (F.col("m") - F.col("i")) * num).alias("core")))
        gone = cells[-1].filter("core").select("hub", "v")
        after = shared_rows(rows.filter("hub <> v").join(gone, ["hub", "v"], "left_anti").select("entry", "v", "n"))
        discard(rows)
        made.append(after)
        left.append(after.filter(F.col("c") <= LARGE))
        rows = after.filter(F.col("c") > LARGE)
        before, many = many, rows.count()
        if many > (1 - ROUND_SHARE) * before:
            left.append(rows)
            break
    return cells, left, made


def cell_rows(members: DataFrame, classes: DataFrame, sets: Sets) -> DataFrame:
    """Members of cells with their sets, once for each block that they meet."""
    held = materialize(sets.of(members.select("v").distinct()), "cell-sets")
    hubs = members.groupBy("v").agg(F.collect_list(F.struct("hub", "core")).alias("hubs"))
    each = held.join(hubs, "v").join(classes.select("v", "size"), "v")
    parts = members.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = members.join(parts, "hub").withColumn("i", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = dealt.select("hub", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), (F.col("i") > F.col("j")).alias("second"), "v", "core")
    return keyed.join(each, "v")


def meet(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """The numbers of tokens that each two sets have in common."""
    rows = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    _, token = np.unique(np.concatenate((*x, *y)), return_inverse=True)
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    out = np.zeros((len(x), len(y)))
    last = int(token[-1]) + 1 if len(token) else 0
    for at in range(0, last, COLUMNS):
        lo, hi = np.searchsorted(token, (at, at + COLUMNS))
        part = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        part[rows[lo:hi], token[lo:hi] - at] = 1
        out += part[: len(x)] @ part[len(x) :].T
    return out


def cell_links(dealt: DataFrame, num: int, den: int, listed: bool) -> DataFrame:
    """a, b, others, similarity: for each member a of a block with links the hub b and the number of the documents linked;
    if ``listed``, each link (a < b) with its similarity instead."""
    keys = ["hub", "lo", "hi"]

    def run(batches):
        for rows in keyed_runs(batches, keys):
            hub = rows.column("hub")[0].as_py()
            second = rows.column("second").to_numpy()
            alone = not second.any()
            if alone and rows.column("lo")[0].as_py() < rows.column("hi")[0].as_py():
                continue
            v, core, size = (rows.column(c).to_numpy() for c in ("v", "core", "size"))
            tokens = [np.asarray(t, np.int64) for t in rows.column("tokens").combine_chunks().to_numpy(zero_copy_only=False)]
            lists = rows.column("hubs").to_pylist()
            # Cells of smaller hubs that hold a pair, one of it in the core, come first.
            earlier = sorted({h["hub"] for x in lists for h in x if h["hub"] < hub})
            place = {h: i for i, h in enumerate(earlier)}
            inside = np.zeros((2, len(v), len(earlier)), np.float32)
            for i, x in enumerate(lists):
                for h in x:
                    if h["hub"] < hub:
                        inside[0, i, place[h["hub"]]] = 1
                        inside[1, i, place[h["hub"]]] = h["core"]
            one, two = (np.flatnonzero(~second), np.flatnonzero(second)) if not alone else (np.arange(len(v)),) * 2
            both = meet([tokens[i] for i in one], [tokens[i] for i in two])
            n = np.array([len(t) for t in tokens])
            union = n[one][:, None] + n[two][None, :] - both
            linked = (both * den >= union * num) & (core[one][:, None] | core[two][None, :])
            linked &= (inside[0][one] @ inside[1][two].T + inside[1][one] @ inside[0][two].T) == 0
            if alone:
                np.fill_diagonal(linked, False)
            if listed:
                if alone:
                    linked = np.triu(linked)
                i, j = np.nonzero(linked)
                a, b = v[one][i], v[two][j]
                yield as_links(np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64), both[i, j] / np.maximum(union[i, j], 1))
                continue
            sides = [(one, linked @ size[two])] + ([] if alone else [(two, linked.T @ size[one])])
            for ids, others in sides:
                some = np.flatnonzero(others)
                yield as_links(v[ids][some], np.full(len(some), hub), others[some], np.zeros(len(some)))

    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "second", "v", "core", "size", "hubs", "tokens").mapInArrow(run, "a long, b long, others long, similarity double")


def as_links(a, b, others, similarity) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(others, pa.int64()), pa.array(similarity, pa.float64())], ["a", "b", "others", "similarity"])


def join_groups(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the smallest doc_id with an equal set), n_links, text_hash and group (the component's inner name)."""
    return Join(docs, width, num, den).groups()


def join_links(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The links (a, b, similarity) between the smallest doc_ids a < b of different classes of equal sets."""
    return Join(docs, width, num, den).links()


class Join:
    """The index of a table, its candidates and its cells, from which groups or links are read."""

    def __init__(self, docs: DataFrame, width: int, num: int, den: int):
        self.num, self.den = num, den
        docs = whole_texts(docs)
        self.rows = materialize(index_rows(docs, width, num, den, frequent_tokens(docs, width, num, den)), "index")
        marks = F.struct("f1", "f2")
        ids = self.rows.groupBy("doc_id").agg(F.min(marks).alias("x"), F.max(marks).alias("y"), F.count("*").alias("times"))
        told = ids.agg(F.count_if(F.expr("x <> y or doc_id is null")).alias("clash"), F.count_if(F.expr("times > 1")).alias("again")).first()
        own = F.col("doc_id")
        rows = self.rows.filter("n > 0")
        if told["clash"]:
            shared = ids.filter("x <> y").select(F.col("doc_id").alias("shared_id"))
            rows = rows.join(shared, F.col("doc_id") == F.col("shared_id"), "left")
            own = F.when(F.col("shared_id").isNull(), F.col("doc_id"))
        # A class is named by its smallest doc_id, or by its fingerprint if no doc_id is its alone.
        classes = rows.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.coalesce(F.min(own), F.col("f1")).alias("v"), F.count("*").alias("size"))
        self.clash = bool(told["clash"])
        self.classes = classes = materialize(classes, "classes")
        self.sets = sets = Sets(docs, width, bool(told["again"]), classes if self.clash else None)
        if self.clash:
            heads = self.rows.filter("size(entries) > 0").join(classes.select("f1", "f2", "v"), ["f1", "f2"]).dropDuplicates(["v"]).select("v", "n", "bits", "entries")
        else:
            heads = self.rows.filter("size(entries) > 0").join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("v"), "n", "bits", "entries")
            if told["again"]:
                heads = heads.dropDuplicates(["v"])
        found = shared_rows(heads.select("v", "n", F.explode("entries").alias("entry")).withColumn("entry", F.col("entry").bitwiseAND(ENTRY)))
        meta = materialize(heads.select("v", "n", "bits").join(found.select("v").distinct(), "v", "left_semi"), "shared-bits")
        cells, left, made = take_hubs(found, meta, sets, num, den)
        rest = reduce(DataFrame.unionByName, [x.select("entry", "c", "v", "n") for x in left])
        near = materialize(entry_pairs(rest, meta, num, den), "pairs")
        self.pairs = verified(near, sets, num, den, "links")
        discard(near)
        self.members = None
        for x in (meta, *(() if cells else made)):
            discard(x)
        if cells:
            members = reduce(DataFrame.unionByName, cells)
            hubs = members.select("hub", F.col("hub").alias("v"), F.lit(True).alias("core"))
            self.members = materialize(members.unionByName(hubs).groupBy("hub", "v").agg(F.max("core").alias("core")), "members")
            for x in made:
                discard(x)
            # Links that a cell holds too are counted there.
            one = self.members.groupBy(F.col("v").alias("a")).agg(F.collect_list(F.struct("hub", "core")).alias("in_a"))
            two = one.select(F.col("a").alias("b"), F.col("in_a").alias("in_b"))
            held = F.exists("in_a", lambda x: F.exists("in_b", lambda y: (x["hub"] == y["hub"]) & (x["core"] | y["core"])))
            self.pairs = materialize(self.pairs.join(one, "a", "left").join(two, "b", "left").filter(~F.coalesce(held, F.lit(False))).select("a", "b", "i", "m"), "links")

    def in_cells(self, listed: bool) -> DataFrame:
        return cell_links(cell_rows(self.members, self.classes, self.sets), self.num, self.den, listed)

    def links(self) -> DataFrame:
        out = self.pairs.select("a", "b", (F.col("i") / (F.col("m") - F.col("i"))).alias("similarity"))
        if self.members is not None:
            out = out.unionByName(self.in_cells(True).select("a", "b", "similarity"))
        if not self.clash:
            return out
        names = self.classes.select("v", "rep")
        out = out.join(names.select(F.col("v").alias("a"), F.col("rep").alias("rep_a")), "a").join(names.select(F.col("v").alias("b"), F.col("rep").alias("rep_b")), "b")
        return out.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b"), "similarity")

    def groups(self) -> DataFrame:
        sizes = self.classes.select(F.col("v").alias("b"), "size")
        ends = self.pairs.select("a", "b").unionByName(self.pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = ends.join(sizes, "b").select("a", F.col("size").alias("others"))
        edges = self.pairs.select("a", "b")
        if self.members is not None:
            inside = materialize(self.in_cells(False), "cell-links")
            others = others.unionByName(inside.select("a", "others"))
            edges = edges.unionByName(inside.select("a", "b"))
        others = others.groupBy(F.col("a").alias("linked")).agg(F.sum("others").alias("others"))
        part = connected_components(edges, "a", "b")
        placed = self.classes.join(part, F.col("v") == F.col("vertex"), "left").join(others, F.col("v") == F.col("linked"), "left")
        placed = placed.select("f1", "f2", "rep", F.coalesce("component", "v").alias("component"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        placed = placed.withColumn("group", F.col("component"))
        if self.clash:
            # The vertices' names are no doc_ids then.
            least = placed.groupBy("group").agg(F.min("rep").alias("least"))
            placed = placed.join(least, "group").select("f1", "f2", "rep", F.col("least").alias("component"), "n_links", "group")
        out = self.rows.select("doc_id", "text_hash", "n", "f1", "f2").join(placed, ["f1", "f2"], "left")
        alone = F.col("n") == 0
        return out.select(
            "doc_id", F.col("n").alias("n_shingles"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
            F.when(alone, F.col("doc_id")).otherwise(F.col("rep")).alias("class_id"),
            F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"), "text_hash", "group",
        )
