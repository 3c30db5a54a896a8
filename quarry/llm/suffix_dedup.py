"""Exact removal of repeated byte strings by suffix arrays in a family of levels of growing size.

A string of ``span`` bytes is placed by its anchor: the first position in it whose 64-byte gram has the least
fingerprint. Equal strings have equal anchors at equal distances, so only the suffixes that begin at anchors are
indexed. An entry is a stretch of neighbouring string starts with one anchor: the bytes left of the anchor and those
from it on. Entries whose anchor gram is found nowhere else are dropped before any text moves. The others are indexed,
of equal entries (by gram and a 64-bit fingerprint of all their bytes) any two, which speak for their copies, so a
passage that a third of all documents quote is indexed twice and no more.

The index of a partition takes entries in batches. A batch gets its suffix array (entries sorted by gram and by the
bytes from the anchor on), is scanned along the existing levels in order for entries with the same gram, and becomes a
level itself; levels of equal size are merged. Where entries share a gram, suffix order with its common-prefix lengths
and the same for the reversed bytes before the anchor give, for each distance of a start from the anchor, classes of
equal strings. All this compares bytes, not fingerprints. The starts found go back to all copies of the entry.

A gram shared by very many different entries (such as the edges of a passage that a third of all documents quote)
would fill one partition, so its entries are dealt into groups of bounded size, each indexed by itself. What a group
does not find repeated, and one of each string that it does, is then counted over all groups, one start at a time by
128-bit fingerprints, which spread over all partitions and are added up before they are moved.

Several spans can be judged at once, in the same passes over the texts. With spans (400, 240), say, the strings of 400
bytes are removed and the bytes that strings of 240 bytes cover are counted too.

Defined results: a null text counts as empty and a text shorter than ``span`` keeps all its bytes; very long texts are
read in pieces, whole; matches never cross documents; strings are judged on the input; each row is a document, so rows
that repeat a doc_id, or have none, are matched like any others and get their own removals; all copies of a string go,
so there are no ties; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, few_ids, materialize, small_batches
from quarry.llm.text_words import mix

SPAN = 400
#: Bytes that any passage of over 50 words has.
PASSAGE = 240
GRAM = 64
#: Texts are read in pieces of this many bytes, so the memory for a text of any length is bounded.
PIECE = 1 << 18
#: Different entries of a gram beyond which they are dealt into groups, and entries of a group.
SPREAD, GROUP = 1000, 500
#: Entries in a batch of the index.
BATCH = 8192

BYTE_MARKS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def grams(data: np.ndarray, width: int) -> np.ndarray:
    """A fingerprint of the ``width`` bytes (a power of two) from each position on."""
    h = BYTE_MARKS[data]
    step = 1
    while step < width:
        h = h[: len(h) - step] * np.uint64(0x9FB21C651E98DF25) + h[step:]
        h = h ^ (h >> np.uint64(29))
        step *= 2
    return mix(h)


def window_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width`` values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    rows = np.concatenate((x, np.full(pad, np.iinfo(np.uint64).max, np.uint64))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def entries(text: bytes, spans: tuple[int, ...] = (SPAN,)) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of string starts with one anchor, piece by piece: span, and arrays of gram, first start, number of starts, anchor."""
    data = np.frombuffer(text, np.uint8)
    low = np.uint64(PIECE * 4 - 1)
    for begin in range(0, max(len(text) - min(spans) + 1, 0), PIECE):
        end = min(len(text), begin + PIECE + max(spans) - 1)
        h = grams(data[begin:end], GRAM)
        # The position goes into the low bits: the least value is the first of equal grams.
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        for span in spans:
            starts = min(PIECE, end - begin - span + 1)
            if starts <= 0:
                continue
            least = window_least(key[: starts + span - GRAM], span - GRAM + 1)
            at = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            ends = np.append(at[1:], len(least))
            anchors = (least[at] & low).astype(np.int64)
            # Grams of different spans never meet.
            marks = mix(h[anchors] + np.uint64(span)).view(np.int64)
            yield span, marks, at + begin, ends - at, anchors + begin


def common_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Entry:
    """An indexed entry: the bytes before its anchor, those from it on, and which of its starts repeat."""

    __slots__ = ("span", "group", "gram", "fp", "left", "right", "spread", "whole", "found")

    def __init__(self, span: int, group: int, gram: int, fp: int, left: bytes, right: bytes, spread: bool = False, whole: bool = False):
        self.span, self.group, self.gram, self.fp, self.left, self.right = span, group, gram, fp, left, right
        self.spread = spread  # its group is not all of its gram
        self.whole = whole  # all starts repeat
        self.found: np.ndarray | None = None

    @property
    def far(self) -> int:
        """The distance of the first start from the anchor, the largest one."""
        return len(self.left)

    @property
    def near(self) -> int:
        """The distance of the last start."""
        return self.span - len(self.right)

    @property
    def starts(self) -> int:
        return self.far - self.near + 1

    def mark(self, low: int, high: int) -> None:
        """The starts at these distances from the anchor repeat."""
        if low <= self.near and high >= self.far:
            self.whole = True
        elif not self.whole:
            if self.found is None:
                self.found = np.zeros(self.starts, bool)
            # Starts are kept in page order, so by falling distance.
            self.found[max(self.far - high, 0) : self.far - low + 1] = True

    def places(self) -> list[tuple[int, int]]:
        """The repeated starts as runs."""
        if self.whole:
            return [(0, self.starts)]
        return [] if self.found is None else runs(self.found)

    def key(self) -> tuple[int, bytes]:
        return self.group, self.right

    def strings(self) -> Iterator[tuple[int, bool, bytes]]:
        """Each start, whether it is known to repeat, and a fingerprint of its string."""
        data = self.left + self.right
        for i in range(self.starts):
            yield i, self.whole or (self.found is not None and bool(self.found[i])), xxhash.xxh3_128_digest(data[i : i + self.span])


class Level:
    """A suffix array: entries in the order of their groups (by gram) and the bytes from the anchor on."""

    def __init__(self, members: list[Entry]):
        members.sort(key=Entry.key)  # runs of a merge are found by the sort
        self.members = members
        self.groups = np.fromiter((e.group for e in members), np.int64, len(members))

    def __len__(self) -> int:
        return len(self.members)


class LevelFamily:
    """Suffix arrays of entries in levels whose sizes are powers of two of a batch."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, batch: list[Entry]) -> None:
        made = Level(batch)
        begin = np.flatnonzero(np.concatenate(([True], made.groups[1:] != made.groups[:-1])))
        kinds, ends = made.groups[begin], np.append(begin[1:], len(batch))
        groups = {g: batch[i:j] for g, i, j in zip(kinds.tolist(), begin.tolist(), ends.tolist(), strict=True)}
        for level in self.levels:
            # Groups rise in both: one scan along the level.
            first, last = np.searchsorted(level.groups, kinds, "left"), np.searchsorted(level.groups, kinds, "right")
            for i in np.flatnonzero(first < last).tolist():
                groups[int(kinds[i])].extend(level.members[first[i] : last[i]])
        for members in groups.values():
            if len(members) > 1:
                match(members, members[0].span)
        while self.levels and len(self.levels[-1]) < 2 * len(made):
            made = Level(self.levels.pop().members + made.members)
        self.levels.append(made)

    def results(self) -> Iterator[Entry]:
        for level in self.levels:
            yield from level.members


def common_suffix(a: bytes, b: bytes) -> int:
    return common_length(a[::-1], b[::-1])


def match(members: list[Entry], span: int) -> None:
    """Mark the starts of entries of one group whose strings are equal to another's."""
    if len(members) <= 24:
        for j, b in enumerate(members):
            for a in members[:j]:
                if a.whole and b.whole:
                    continue
                right = common_length(a.right, b.right)
                left = min(len(a.left), len(b.left)) if a.left == b.left else common_suffix(a.left, b.left)
                # A start at distance d is common if d bytes before the anchor and span - d from it are.
                low, high = max(span - right, a.near, b.near), left
                if low <= high:
                    a.mark(low, high)
                    b.mark(low, high)
        return
    n = len(members)
    lefts = [m.left[::-1] for m in members]
    by_right = sorted(range(n), key=lambda i: members[i].right)
    by_left = sorted(range(n), key=lambda i: lefts[i])
    order_r, order_l = np.array(by_right), np.array(by_left)
    common_r = np.array([span + 1] + [common_length(members[a].right, members[b].right) for a, b in zip(by_right, by_right[1:])])
    common_l = np.array([span + 1] + [common_length(lefts[a], lefts[b]) for a, b in zip(by_left, by_left[1:])])
    near = np.array([m.near for m in members])
    far = np.array([m.far for m in members])
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(int(near.min()), int(far.max()) + 1):
        here = np.flatnonzero((near <= d) & (d <= far))
        if len(here) < 2:
            continue
        # The string's right part has span - d bytes and its left part d; shorter entries don't take part here.
        class_r[order_r] = np.cumsum(common_r < span - d)
        class_l[order_l] = np.cumsum(common_l < d)
        _, back, count = np.unique(class_r[here] * (n + 1) + class_l[here], return_inverse=True, return_counts=True)
        for i in here[count[back] > 1].tolist():
            members[i].mark(d, d)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of true values."""
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def rows_of(docs: DataFrame, *more) -> DataFrame:
    """doc_id, text, and the two numbers that tell rows apart: the id and a fingerprint of the text."""
    text = F.col("text").cast("string")
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), *more)


def entry_marks(docs: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """id, h, gram, fp, span, start, n, anchor of every entry of every document."""
    names = ["id", "h", "gram", "fp", "span", "start", "n", "anchor"]
    kinds = [np.int64] * 4 + [np.int32, np.int64, np.int32, np.int32]

    def made(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k, copy=False)) for c, k in zip(zip(*parts, strict=True), kinds, strict=True)], names)

    def run(batches):
        parts, size = [], 0
        for batch in small_batches(batches):
            for key, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = raw(text.as_py())
                for span, gram, start, n, anchor in entries(data, spans):
                    places = zip(start.tolist(), (start + n + span - 1).tolist(), (anchor - start).tolist(), strict=True)
                    fp = np.fromiter((xxhash.xxh3_64_intdigest(data[i:j], k) for i, j, k in places), np.uint64, len(start)).view(np.int64)
                    parts.append((np.full(len(start), key), np.full(len(start), h), gram, fp, np.full(len(start), span), start, n, anchor - start))
                    size += len(start)
                if size > 50_000:
                    yield made(parts)
                    parts, size = [], 0
        if parts:
            yield made(parts)

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, gram long, fp long, span int, start long, n int, anchor int")


def shared_entries(docs: DataFrame, spans: tuple[int, ...]) -> DataFrame:
    """The entries whose gram is found more than once: how often they are to be indexed, and in which group."""
    marks = materialize(entry_marks(docs, spans), "entries")
    often = marks.groupBy("gram").agg(F.count("*").alias("total")).filter("total > 1").select("gram")
    kept = materialize(marks.join(often, "gram", "left_semi"), "recurring-entries")
    discard(marks)
    own = F.xxhash64("id", "h", "start")
    equal = kept.groupBy("gram", "fp").agg(F.count("*").alias("copies"), F.min(own).alias("one"), F.max(own).alias("two"))
    equal = materialize(equal, "equal-entries")
    kinds = equal.groupBy("gram").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > SPREAD)
    found = kept.join(equal, ["gram", "fp"]).join(kinds, "gram", "left")
    # Two of a set of equal entries speak for all; of rows that are equal altogether, one twice. One does in a gram whose
    # entries are dealt out, all of whose strings repeat if the entry does.
    first, second, spread_ = own == F.col("one"), own == F.col("two"), F.col("kinds").isNotNull()
    times = F.when(spread_, first.cast("int")).when(~first & ~second, 0).when((F.col("copies") > 1) & (F.col("one") == F.col("two")), 2).otherwise(1)
    group = F.when(spread_, F.xxhash64("gram", F.pmod("fp", F.ceil(F.col("kinds") / GROUP)))).otherwise(F.col("gram"))
    out = materialize(found.select("id", "h", "gram", "fp", "span", "start", "n", "anchor", times.alias("times"), group.alias("group"), spread_.alias("spread"), (F.col("copies") > 1).alias("equal")), "shared-entries")
    discard(kept)
    discard(equal)
    return out


def place(docs: DataFrame, sent: DataFrame) -> DataFrame:
    """The entries to be indexed, with their bytes left of the anchor and from it on."""
    names = ["span", "group", "gram", "fp", "left", "right", "spread", "whole"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        for batch in small_batches(batches):
            rows, size = [], 0
            for text, marks in zip(batch.column(0), batch.column(1), strict=True):
                data = raw(text.as_py())
                for span, group, gram, fp, start, n, anchor, times, spread, equal in zip(*(x.to_pylist() for x in marks.values.flatten()), strict=True):
                    stop = start + n + span - 1
                    rows += [(span, group, gram, fp, data[start : start + anchor], data[start + anchor : stop], spread, spread and equal)] * times
                    size += stop - start
                    if size > 8_000_000:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    lists = sent.groupBy("id", "h").agg(F.collect_set(F.struct("span", "group", "gram", "fp", "start", "n", "anchor", "times", "spread", "equal")).alias("marks"))
    texts = docs.join(lists, ["id", "h"]).select("text", "marks")
    return texts.mapInArrow(run, "span int, group long, gram long, fp long, left binary, right binary, spread boolean, whole boolean")


#: Starts [i, j) of an entry, counted from its first one; single strings of dealt-out entries come with a fingerprint
#: (a, b), and if it is not known whether they repeat, they are ``open``.
FOUND = pa.schema([("gram", pa.int64()), ("fp", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_())])


def indexed(rows: DataFrame) -> DataFrame:
    """What the suffix arrays find of the entries to be indexed."""

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), FOUND, strict=True)], schema=FOUND)

    def run(batches):
        family = LevelFamily()
        held: list[Entry] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                held.append(Entry(*row))
                if len(held) >= BATCH:
                    family.add(held)
                    held = []
        if held:
            family.add(held)
        out, told = [], {}
        for e in family.results():
            out += [(e.gram, e.fp, i, j, None, None, None) for i, j in e.places()]
            if e.spread:
                once = told.setdefault(e.group, set())
                for i, known, mark in e.strings():
                    if known and mark in once:
                        continue
                    once.add(mark)
                    a, b = np.frombuffer(mark, np.int64).tolist()
                    out.append((e.gram, e.fp, i, i + 1, a, b, not known))
            if len(out) > 20_000:
                yield made(out)
                out = []
        if out:
            yield made(out)

    schema = "gram long, fp long, i int, j int, a long, b long, open boolean"
    return rows.repartition("group").mapInArrow(run, schema)


def over_groups(found: DataFrame) -> DataFrame:
    """The open strings that another group has too."""
    single = found.filter("a is not null")
    often = single.groupBy("a", "b").agg(F.count("*").alias("times")).filter("times > 1").drop("times")
    return single.filter("open").join(often, ["a", "b"]).select("gram", "fp", "i", "j")


def repeated_places(docs: DataFrame, spans: tuple[int, ...] = (SPAN,)) -> DataFrame:
    """id, h and, for each span, the repeated string starts of the rows of ``rows_of``: arrays of start * 2^20 + number."""
    flagged = shared_entries(docs.filter(F.octet_length("text") >= min(spans)), spans)
    sent = flagged.filter("times > 0")
    texts = docs.join(few_ids(sent.select("id").distinct()), "id", "left_semi")
    found = materialize(indexed(place(texts, sent)), "repeated-entries")
    places = found.filter("a is null").select("gram", "fp", "i", "j").distinct().unionByName(over_groups(found))
    placed = flagged.join(places, ["gram", "fp"]).select("id", "h", "span", (F.col("start") + F.col("i")).alias("at"), (F.col("j") - F.col("i")).alias("n"))
    packed = placed.withColumn("place", F.shiftleft("at", 20) + F.col("n"))
    lists = [F.collect_set(F.when(F.col("span") == span, F.col("place"))).alias(f"places_{i}") for i, span in enumerate(spans)]
    out = materialize(packed.groupBy("id", "h").agg(*lists), "repeated")
    for x in (flagged, found):
        discard(x)
    return out


def covered(n: int, places: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the strings of one span at the given starts (packed) cover."""
    if not len(places):
        return []
    places = np.sort(places)
    begin = places >> 20
    end = np.maximum.accumulate(np.minimum(begin + (places & ((1 << 20) - 1)) - 1 + span, n))
    first = np.concatenate(([True], begin[1:] > end[:-1]))
    return list(zip(begin[first].tolist(), end[np.append(first[1:], True)].tolist(), strict=True))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def dedup(docs: DataFrame, span: int = SPAN, passage: int | None = None, keep_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``passage``, also n_passage_bytes, the bytes that repeated strings of so many bytes cover; they stay. With
    ``keep_text``, also the text, the kept text and the removed spans; the kept text leaves out the bytes of a character of
    which only a part was removed. Columns named in ``carry`` are passed through.
    """
    spans = (span, passage) if passage else (span,)
    places = few_places(repeated_places(rows_of(docs), spans))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
    if passage:
        schema, kinds = schema + ", n_passage_bytes long", kinds | {"n_passage_bytes": pa.int64()}
    if keep_text:
        schema, kinds = schema + ", text string, kept string, spans array<struct<start: long, stop: long>>", kinds | {"text": pa.string(), "kept": pa.string(), "spans": SPANS}

    none = np.empty(0, np.int64)

    def run(batches):
        for batch in small_batches(batches):
            rows = {name: [] for name in kinds}
            for text, *found in zip(batch.column(1), *(batch.column(2 + i) for i, _ in enumerate(spans)), strict=True):
                data = raw(text.as_py())
                found = [np.asarray(x.values, np.int64) if x.is_valid else none for x in found]
                gone = covered(len(data), found[0], span)
                kept = b"".join(data[a:b] for a, b in zip([0, *[g[1] for g in gone]], [*[g[0] for g in gone], len(data)], strict=True))
                rows["n_bytes"].append(len(data))
                rows["n_removed"].append(len(data) - len(kept))
                rows["n_spans"].append(len(gone))
                rows["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if passage:
                    rows["n_passage_bytes"].append(sum(b - a for a, b in covered(len(data), found[1], passage)))
                if keep_text:
                    rows["text"].append(text.as_py())
                    rows["kept"].append(kept.decode("utf-8", "ignore"))
                    rows["spans"].append([{"start": a, "stop": b} for a, b in gone])
            arrays = {"doc_id": batch.column(0)} | {k: pa.array(v, kinds[k]) for k, v in rows.items()}
            yield pa.RecordBatch.from_pydict(arrays | {f"carried_{i}": batch.column(2 + len(spans) + i) for i, _ in enumerate(carry)})

    whole = rows_of(docs, *[F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)])
    for i, _ in enumerate(carry):
        schema += f", carried_{i} {whole.schema[f'carried_{i}'].dataType.simpleString()}"
    out = whole.join(places, ["id", "h"], "left").select("doc_id", "text", *[f"places_{i}" for i, _ in enumerate(spans)], *[f"carried_{i}" for i, _ in enumerate(carry)]).mapInArrow(run, schema)
    for i, c in enumerate(carry):
        out = out.withColumnRenamed(f"carried_{i}", c)
    return out


#: Place lists are broadcast only if they hold fewer places in all than this (8 bytes each).
BROADCAST_PLACES = 500_000


def few_places(places: DataFrame) -> DataFrame:
    total = places.agg(F.sum(sum((F.size(c) for c in places.columns if c.startswith("places_")), F.lit(1)))).first()[0] or 0
    return F.broadcast(places) if total <= BROADCAST_PLACES else places
