"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton lists every vocabulary match of a stretch; dynamic programming carries, for each position,
the best score of the text before it and the number of pieces on that best way. Ties go as in the tokenizers library:
among equal scores the match that starts first stays. A character that no one-character piece covers may also be
unknown, at a cost of ten below the lowest score; it then counts one piece for each of its UTF-8 bytes if the
vocabulary has byte pieces, else neighbouring unknown characters count as one.

Scores are rounded to multiples of 2^-16, so that sums are exact and stretches that no piece crosses can be counted by
themselves and kept in a bounded table.

Defined results: a null or empty text has 0 tokens; very long texts are counted whole, in time that grows with their length;
each row is handled by itself, so ties and repeated rows need
nothing; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import Memo
from quarry.llm.common import small_batches

MARK = "▁"  # stands for a space
UNKNOWN_PENALTY = 10.0
SCHEMA = "doc_id long, n_chars long, n_tokens long"


def zipf_scores(pieces: list[str]) -> list[tuple[str, float]]:
    """Pieces in order of frequency with log probabilities by Zipf's rule, as multiples of 2^-16."""
    total = math.log(sum(1 / (i + 1) for i in range(len(pieces))))
    return [(p, round((-math.log(i + 1) - total) * 65536) / 65536) for i, p in enumerate(pieces)]


def vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece file: unknown and byte pieces first, then the rest by the file's own order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    size = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(size)]
    held = [i for i in range(size) if model.is_unknown(i) or model.is_control(i) or model.is_byte(i)]
    plain = [i for i in range(size) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
    plain.sort(key=lambda i: (-model.get_score(i), i))
    scored = zipf_scores([names[i] for i in plain])
    low = min(s for _, s in scored)
    return [(names[i], low) for i in held if not model.is_control(i)] + scored


class UnigramCounter:
    """Counts the pieces of the best segmentation. ``vocab`` holds (piece, score); the piece <unk> is the unknown."""

    def __init__(self, vocab: list[tuple[str, float]]):
        names = {p for p, _ in vocab}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.machine = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = {p for p in names if len(p) == 1}
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        joined = {c for p in names if len(p) > 1 for c in p}
        #: No piece crosses from another character into a mark, so a stretch may end there.
        self.parted = not any(MARK in p.lstrip(MARK) for p in names)
        #: A line feed inside no longer piece parts stretches too.
        self.lines = "\n" not in joined
        self.exact = all((s * 65536).is_integer() for _, s in vocab)
        self.counts = Memo(self.count_stretch, 150_000)

    def count_stretch(self, s: str) -> int:
        n = len(s)
        best = [-math.inf] * (n + 1)
        pieces = [0] * (n + 1)
        loose = [False] * (n + 1)  # the way ends with an unknown character
        best[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (size, score) in self.machine.iter(s):
            ends[end].append((size, score))
        single = self.single
        for end in range(n):
            to, top, way, unknown = end + 1, -math.inf, 0, False
            for size, score in ends[end]:  # the longest first: it starts first
                x = best[to - size] + score
                if x > top:
                    top, way, unknown = x, pieces[to - size] + 1, False
            if s[end] not in single:
                x = best[end] + self.unknown
                if x > top:
                    top, unknown = x, True
                    if self.bytes:
                        way = pieces[end] + len(s[end].encode("utf-8", "surrogatepass"))
                    else:
                        way = pieces[end] + (0 if loose[end] else 1)
            best[to], pieces[to], loose[to] = top, way, unknown
        return pieces[n]

    def count(self, text: str | None) -> int:
        """Pieces of a text whose spaces become marks, with one mark in front."""
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not (self.parted and self.exact and self.bytes):
            return self.count_stretch(text)
        counts = self.counts
        if not self.lines:
            return sum([counts[x] for x in STRETCH.findall(text)])
        total = 0
        for i, line in enumerate(text.split("\n")):
            if i:
                total += counts["\n"]
            total += sum([counts[x] for x in STRETCH.findall(line)])
        return total


STRETCH = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary(path))


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_chars and n_tokens of every text."""
    def run(batches):
        counter = load(model_path)
        for batch in small_batches(batches):
            texts = [x.as_py() or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0),
                "n_chars": pa.array(map(len, texts), pa.int64()),
                "n_tokens": pa.array(map(counter.count, texts), pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
