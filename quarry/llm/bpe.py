"""Byte-pair encoding and decoding with a word-end vocabulary.

Encoding keeps the symbols of a word in a doubly linked list and the possible merges in a priority queue of
(rank, position). An entry popped from the queue is skipped if its symbols have changed since it was pushed.
Decoding concatenates vocabulary strings. Words repeat, so each task keeps the encoded words in a bounded table.

Defined results: a null text counts as empty; an empty text, or one of white space only, has no ids and decodes to
the empty string; strings of special tokens become these tokens, as the file says; very long texts, and very long words, are encoded whole;
each row is handled by itself, so
ties and repeated rows need nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import small_batches

#: Encoded words, and stretches between white space, that one task keeps in each of two generations.
CACHE_WORDS = 150_000
CACHE_CHUNKS = 60_000

#: The separators that str.split() takes for white space though Unicode does not.
SEPARATORS = re.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\p{White_Space}+")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable bytes themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Memo(dict):
    """A table of two bounded generations that computes what it lacks: a full one becomes the old one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """A tokenizer file with word ends: NFC, lower case, white space dropped, byte letters, merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.merges = {(self.vocab[a] << 20) | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        letters = byte_letters()
        self.inner = [self.vocab.get(x) for x in letters]
        self.final = [self.vocab.get(x + self.suffix) for x in letters]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        # White_Space is spelt out: the usual class also takes the separators U+001C to U+001F.
        self.words = regex.compile(split.replace(r"\s", r"\p{White_Space}"))
        self.marks = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.word = Memo(self.both, CACHE_WORDS)
        self.mixed = Memo(self.joined, CACHE_CHUNKS)

    def joined(self, chunk: str) -> tuple[bytes, bytes]:
        """What ``both`` gives, for the words of a stretch that is not letters only."""
        parts = [self.word[w] for w in self.words.findall(chunk)]
        return b"".join([x[0] for x in parts]), b" ".join([x[1] for x in parts])

    def both(self, word: str) -> tuple[bytes, bytes]:
        """The ids of a word, packed, and the text that these ids decode to, in UTF-8."""
        ids = self.encode_word(word)
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode("utf-8")

    def encode_word(self, word: str) -> list[int]:
        """Merge the symbols of one word, lowest rank first and leftmost first among equals."""
        raw = word.encode("utf-8")
        inner = self.inner
        sym = [inner[b] for b in raw]
        sym[-1] = self.final[raw[-1]]
        if None in sym:  # the vocabulary lacks a letter: it is left out
            sym = [x for x in sym if x is not None]
        n = len(sym)
        rank_of, made_by = self.merges.get, self.made
        queue = []
        left = sym[0] if n else 0
        for i in range(1, n):
            right = sym[i]
            rank = rank_of((left << 20) | right)
            if rank is not None:
                queue.append((rank << 32) | (i - 1))
            left = right
        if not queue:
            return sym
        heapify(queue)
        before = list(range(-1, n - 1))
        after = [*range(1, n), -1]
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            here = sym[i]
            j = after[i]
            if here < 0 or j < 0:
                continue
            made = made_by[top >> 32]
            rank = rank_of((here << 20) | sym[j])
            if rank is None or made_by[rank] != made:
                continue
            sym[i] = made
            sym[j] = -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank = rank_of((made << 20) | sym[k])
                if rank is not None:
                    heappush(queue, (rank << 32) | i)
            k = before[i]
            if k >= 0:
                rank = rank_of((sym[k] << 20) | made)
                if rank is not None:
                    heappush(queue, (rank << 32) | k)
        return [s for s in sym if s >= 0]

    def chunks(self, text: str) -> list[str]:
        """Stretches without white space; no word crosses their bounds."""
        # Each letter is lowered by itself: a final sigma does not depend on its place.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return SPACES.split(text) if SEPARATORS.search(text) else text.split()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return self.digest_parts(text)[0]

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings one after the other, parted by spaces since the file names no decoder."""
        return " ".join(map(self.strings.__getitem__, ids))

    def digest_parts(self, text: str | None) -> tuple[bytes, bytes]:
        """The ids of a text and the text that they decode to, in UTF-8."""
        text = text or ""
        ids_out: list[bytes] = []
        texts_out: list[bytes] = []
        at = 0
        for m in [*self.marks.finditer(text), None]:
            chunks = self.chunks(text[at : m.start()] if m else text[at:])
            word, mixed = self.word, self.mixed
            parts = [word[c] if c.isalpha() else mixed[c] for c in chunks]
            ids_out += [x[0] for x in parts]
            texts_out += [x[1] for x in parts]
            if m:
                at = m.end()
                ids_out.append(struct.pack("<I", self.special[m[0]]))
                texts_out.append(m[0].encode("utf-8"))
        return b"".join(ids_out), b" ".join(filter(None, texts_out))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, tokenizer_path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded text and, if asked for, the ids (packed as ``encode`` does) and that text."""
    schema = SCHEMA + (", ids binary, decoded string" if keep_ids else "")

    def run(batches):
        bpe = load(tokenizer_path)
        for batch in small_batches(batches):
            doc_ids, texts = batch.column(0), batch.column(1)
            n, a, b, ids_col, dec_col = [], [], [], [], []
            for text in texts:
                ids, decoded = bpe.digest_parts(text.as_py())
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    ids_col.append(ids)
                    dec_col.append(decoded.decode("utf-8"))
            cols = {"doc_id": doc_ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())}
            if keep_ids:
                cols |= {"ids": pa.array(ids_col, pa.binary()), "decoded": pa.array(dec_col, pa.string())}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
