"""Byte-level byte-pair encoding and decoding by recursive DuckDB queries inside each partition.

A rank file maps strings of bytes to ranks, which are also their ids. Each match of the splitting pattern is a word of
its own. A task collects the words of a batch that it has not seen, lays them out as token-position rows, one for each
byte, and lets a recursive query contract them: rows join the table of merges with their right neighbour, the leftmost
pair of the lowest rank in each word becomes one token, and the query goes on with the words that changed until none does.

Nearly all words are short, and a step is a window, a join and two aggregations over the rows of all of them. A long word
would take as many steps as it has tokens to lose, so it is cut into overlapping windows that are contracted like words.
Tokens are the encoding of their string if each two neighbours are that of theirs; so two windows join at any token that
both have at the same place. A word with windows that share none is contracted whole. In a trained vocabulary each token
encodes to itself, so a contraction never makes a pair of a rank as low, and for windows and whole long words a step
contracts the further disjoint pairs of the lowest rank, too (``trained=False``, for other rank files, leaves that out
and the windows).

Ordered aggregation gathers the ids of each word and decodes them. Words repeat, so a task keeps a table of bounded size.

Defined results: a null text counts as empty; an empty text has no ids and decodes to no bytes; strings of special
tokens are ordinary text; very long texts are encoded whole, a batch of words at a time (a single match of the pattern
is one batch at least: some hundred bytes of memory for each of its bytes); each row is handled by itself, so ties and
repeated rows need nothing; an empty table gives an empty table; other columns are not read. A rank file that lacks a
single byte is refused.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

#: Words whose encoding a task keeps, and the length in bytes of those that it keeps.
CACHE_WORDS, CACHE_BYTES = 400_000, 64
#: Characters of text that are split into words at a time, and bytes of new words in one query.
TEXT_CHARS, QUERY_BYTES = 2_000_000, 500_000
#: Longer words are cut into windows of so many bytes, half of which each shares with the next.
WINDOW = 256

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

#: Words of up to so many bytes are short. A row of theirs has the key 64 * word + place among the word's tokens.
SHORT = 32
CONTRACT_SHORT = """
WITH RECURSIVE s(step, k, id) AS (
  SELECT 0, CAST(word AS BIGINT) * 64 + pos, id FROM start
  UNION ALL (
    WITH neighbours AS (SELECT k, id, lead(id) OVER w AS following, lead(k) OVER w AS after FROM s WINDOW w AS (ORDER BY k)),
    lowest AS (
      SELECT k // 64 AS word, min(CAST(made AS BIGINT) * 64 + k % 64) AS first
      FROM neighbours JOIN merges ON pair = CAST(id AS BIGINT) * 65536 + following WHERE after = k + 1 GROUP BY k // 64
    ),
    merged AS (SELECT word, word * 64 + first % 64 AS here, CAST(first // 64 AS INTEGER) AS made FROM lowest)
    SELECT step + 1, CASE WHEN k > here THEN k - 1 ELSE k END, CASE WHEN k = here THEN made ELSE id END
    FROM s JOIN merged ON k // 64 = word WHERE k <> here + 1
  )
), final AS (SELECT k // 64 AS word, max(step) AS last FROM s GROUP BY k // 64)
SELECT word, list(s.id ORDER BY k) AS ids, string_agg(piece, '' ORDER BY k) AS decoded
FROM s JOIN final ON word = k // 64 AND step = last JOIN vocabulary v ON v.id = s.id GROUP BY word ORDER BY word
"""

#: The right half of a contracted pair gets the id -1. ``nth_in_run`` counts within neighbouring pairs of the lowest rank.
CONTRACT_LONG = """
WITH RECURSIVE s(word, pos, id) USING KEY (word, pos) AS (
  SELECT word, pos, id FROM start
  UNION
  SELECT word, unnest([pos, after]), unnest([made, -1])
  FROM (
    SELECT *, row_number() OVER (PARTITION BY word, n - nth ORDER BY n) AS nth_in_run
    FROM (
      SELECT *, row_number() OVER (PARTITION BY word ORDER BY n) AS nth
      FROM (
        SELECT p.*, made, min(made) OVER (PARTITION BY word) AS lowest
        FROM (
          SELECT word, pos, id, lead(id) OVER w AS following, lead(pos) OVER w AS after, row_number() OVER w AS n
          FROM recurring.s WHERE id >= 0 AND word IN (SELECT word FROM s)
          WINDOW w AS (PARTITION BY word ORDER BY pos)
        ) p JOIN merges ON pair = CAST(id AS BIGINT) * 65536 + following
      ) WHERE made = lowest
    )
  ) WHERE {which}
)
SELECT word, list(s.id ORDER BY pos) AS ids, string_agg(piece, '' ORDER BY pos) AS decoded, list(pos ORDER BY pos) AS places
FROM s JOIN vocabulary v ON v.id = s.id GROUP BY word ORDER BY word
"""

DECODE = """
SELECT doc, count(*) AS n, count(piece) AS known, string_agg(piece, '' ORDER BY pos) AS decoded
FROM tokens t LEFT JOIN vocabulary v ON v.id = t.id GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class ByteBpe:
    """A rank file and a splitting pattern, with the tables that the queries join."""

    def __init__(self, path: str, pattern: str, trained: bool = True):
        self.ranks = read_ranks(path)
        lacking = [b for b in range(256) if bytes([b]) not in self.ranks]
        if lacking:
            raise ValueError(f"{path} has no rank for the bytes {lacking[:8]}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # White space is spelt out: the usual class also takes the separators U+001C to U+001F.
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        if max(self.ranks.values()) >= 65536:
            raise ValueError(f"{path} has ranks beyond 65535")
        self.trained = trained
        self.contract_long = CONTRACT_LONG.format(which="nth_in_run % 2 = 1" if trained else "nth = 1")
        known = self.ranks.get
        merges = [(known(t[:i]) * 65536 + known(t[i:]), rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        self.put("merges", {"pair": pa.array([pair for pair, _ in merges], pa.int64()), "made": pa.array([made for _, made in merges], pa.int32())})
        self.put("vocabulary", {"id": pa.array(self.ranks.values(), pa.int32()), "piece": pa.array([t.hex() for t in self.ranks], pa.string())})
        #: Two generations: a full one becomes the old one.
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    def put(self, name: str, columns: dict[str, pa.Array]) -> None:
        self.con.register("incoming", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM incoming")
        self.con.unregister("incoming")

    def contract(self, words: list[bytes], query: str) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """What a query gives for words, the ids of all of them one after the other, and the bounds of the words in these."""
        sizes = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(sizes) - sizes
        rows = {"word": np.repeat(np.arange(len(words), dtype=np.int32), sizes), "pos": (np.arange(len(raw)) - np.repeat(starts, sizes)).astype(np.int32), "id": self.byte_ids[raw]}
        self.con.register("start", pa.table(rows))
        found = self.con.sql(query).to_arrow_table()
        self.con.unregister("start")
        return found, *flat_lists(found.column("ids"))

    def contracted(self, words: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, bytes]]:
        """Of each long word or window the ids, the places where these tokens start, and the bytes that they decode to."""
        found, ids, ends = self.contract(words, self.contract_long)
        places = flat_lists(found.column("places"))[0]
        return [(ids[a:b], places[a:b], bytes.fromhex(x)) for a, b, x in zip(ends[:-1], ends[1:], found.column("decoded").to_pylist(), strict=True)]

    def encode_short(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        found, ids, ends = self.contract(words, CONTRACT_SHORT)
        packed, ends = ids.astype("<u4").tobytes(), (ends * 4).tolist()
        decoded = map(bytes.fromhex, found.column("decoded").to_pylist())
        return zip(map(packed.__getitem__, map(slice, ends[:-1], ends[1:])), decoded, strict=True)

    def encode_long(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        cuts = [range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2) if self.trained and len(w) > WINDOW else range(1) for w in words]
        parts = self.contracted([w[at : at + WINDOW] if len(cut) > 1 else w for w, cut in zip(words, cuts, strict=True) for at in cut])
        used = 0
        for w, cut in zip(words, cuts, strict=True):
            ids, _, decoded = parts[used] if len(cut) == 1 else self.joined(parts[used : used + len(cut)], cut) or self.contracted([w])[0]
            used += len(cut)
            yield ids.astype("<u4").tobytes(), decoded

    def encode_words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids of each word, packed as little-endian unsigned 32-bit integers, and the bytes that they decode to."""
        short = [len(w) <= SHORT for w in words]
        of = {kind: [w for w, x in zip(words, short, strict=True) if x is kind] for kind in (True, False)}
        results = {True: iter(self.encode_short(of[True]) if of[True] else ()), False: iter(self.encode_long(of[False]) if of[False] else ())}
        return [next(results[x]) for x in short]

    @staticmethod
    def joined(parts: list[tuple[np.ndarray, np.ndarray, bytes]], cut: range) -> tuple[np.ndarray, np.ndarray, bytes] | None:
        """The windows of a word as one, each with its next at a token that both have; None if some share none."""
        kept, text, first = [], [], 0
        for (ids, places, decoded), following in zip(parts, [*parts[1:], None], strict=True):
            last, begin = len(ids), first
            if following is not None:
                _, mine, other = np.intersect1d((places - cut.step) << 32 | ids, following[1] << 32 | following[0], return_indices=True)
                usable = mine > first
                if not usable.any():
                    return None
                last, first = mine[usable][0], other[usable][0]
            kept.append(ids[begin:last])
            text.append(decoded[places[begin] : places[last] if last < len(places) else None])
        ids = np.concatenate(kept)
        return ids, np.empty(0, np.int64), b"".join(text)

    def learn(self, words: set[str]) -> None:
        """Encode what the table lacks. A full table becomes the old one, whose words come back when they are met."""
        lacking = words.difference(self.cache)
        if len(self.cache) + len(lacking) > CACHE_WORDS:
            self.old = self.cache
            lacking = words
            self.cache = {}
        known = {w: self.old[w] for w in lacking if w in self.old}
        self.cache.update(known)
        new = [w for w in lacking if w not in known]
        at = 0
        while at < len(new):
            part, size = [], 0
            while at < len(new) and (not part or size < QUERY_BYTES):
                part.append(new[at].encode("utf-8"))
                size += len(part[-1])
                at += 1
            self.cache.update(zip(new[at - len(part) : at], self.encode_words(part), strict=True))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and decoded bytes of each text; the words of several texts are looked up together."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and (not split or size < TEXT_CHARS):
                text = texts[at] or ""
                split.append(self.words.findall(text))
                size += len(text)
                at += 1
            seen = set().union(*split)
            self.learn(seen)
            for words in split:
                ids, decoded = zip(*map(self.cache.__getitem__, words), strict=True) if words else ((), ())
                yield b"".join(ids), b"".join(decoded)
            for w in [w for w in seen if len(w) > CACHE_BYTES]:
                del self.cache[w]

    def decode(self, packed: list[bytes | None]) -> list[bytes]:
        """The bytes of each row's ids, one token after the other."""
        ids = [np.frombuffer(x or b"", "<u4") for x in packed]
        sizes = np.array([len(x) for x in ids], np.int64)
        flat = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int64)
        self.con.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids)), sizes), "pos": np.arange(len(flat)), "id": flat}))
        out = [b""] * len(ids)
        for doc, n, known, decoded in self.con.sql(DECODE).fetchall():
            if n != known:
                raise ValueError(f"{n - known} ids are not in the vocabulary")
            out[doc] = bytes.fromhex(decoded)
        self.con.unregister("tokens")
        return out


def flat_lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column one after the other, and the bounds of the rows in them."""
    whole = column.combine_chunks()
    whole = whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)
    return whole.values.to_numpy().astype(np.int64), whole.offsets.to_numpy()


@lru_cache(maxsize=2)
def load(path: str, pattern: str, trained: bool) -> ByteBpe:
    return ByteBpe(path, pattern, trained)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False, trained: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes and, if asked for, the packed ids and those bytes."""

    def run(batches):
        bpe = load(ranks_path, pattern, trained)
        for batch in small_batches(batches):
            found = list(bpe.encode(batch.column(1).to_pylist()))
            cols = {
                "doc_id": batch.column(0),
                "n_tokens": pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(text).hexdigest() for _, text in found], pa.string()),
            }
            if keep_ids:
                cols |= {"ids": pa.array([ids for ids, _ in found], pa.binary()), "decoded": pa.array([text for _, text in found], pa.binary())}
            yield pa.RecordBatch.from_pydict(cols)

    schema = SCHEMA + (", ids binary, decoded binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and decoded (bytes) of rows with packed ids, as ``encode_documents`` keeps them; null ids count as none."""

    def run(batches):
        bpe = load(ranks_path, pattern, True)
        for batch in small_batches(batches, 100):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "decoded": pa.array(bpe.decode(batch.column(1).to_pylist()), pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")
