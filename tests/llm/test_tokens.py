"""Encoding, decoding and counting against the tokenizers library."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer, models, normalizers

from quarry.llm import bpe, unigram

tokens = pytest.importorskip("public_tokenizers")

ODD = [
    "", "  ", " a", "<|endoftext|>x", "a<|startoftext|><|endoftext|>b 's IT'S we'll ΣΑΣ İstanbul", "\x1c\x1d\x85 a²½Ⅷ", "é é ñ",
    "日本語テキスト 😀😀 ", "don't \"x\" y", "A" * 3000, "<s><unk> x<0x0A>y", "\n\n a",
]
random.seed(3)
ODD += ["".join(random.choice("aB'sS tT\n\x1c\x85 é́-<|>x1²日😀") for _ in range(60)) for _ in range(200)]


def test_bpe_matches_the_library(spark, documents):
    path = tokens.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    got = {r.doc_id: r for r in bpe.encode_documents(documents(rows), path, keep_ids=True).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert bytes(got[i].ids) == packed and got[i].n_tokens == len(ids)
        assert got[i].decoded == text
        assert got[i].ids_sha256 == hashlib.sha256(packed).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_very_long_texts(spark, documents):
    # A megabyte of words, one word of 300,000 letters, and one without any repetition.
    random.seed(8)
    rows = [(1, "some words 12 " * 75_000), (2, "a" * 300_000), (3, "".join(random.choice("abcdefgh") for _ in range(50_000)))]
    bpe_path, piece_path = tokens.path("word_bpe_49k.json"), tokens.path("piece_bpe_32k.model")
    words, pieces = Tokenizer.from_file(bpe_path), library_of(unigram.vocabulary(piece_path), True)
    encoded = {r.doc_id: r for r in bpe.encode_documents(documents(rows), bpe_path).collect()}
    counted = {r.doc_id: r.n_tokens for r in unigram.count_tokens(documents(rows), piece_path).collect()}
    for i, text in rows:
        ids = words.encode(text, add_special_tokens=False).ids
        assert (encoded[i].n_tokens, encoded[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert counted[i] == len(pieces.encode(text, add_special_tokens=False).ids)


def test_bpe_on_an_empty_table(documents):
    assert bpe.encode_documents(documents([(1, "a")]).limit(0), tokens.path("word_bpe_49k.json")).count() == 0


def library_of(vocab, byte_fallback):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.normalizer = normalizers.Sequence([normalizers.Prepend(unigram.MARK), normalizers.Replace(" ", unigram.MARK)])
    return t


def test_counts_match_the_library(spark, documents):
    path = tokens.path("piece_bpe_32k.model")
    library = library_of(unigram.vocabulary(path), True)
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    got = {r.doc_id: r.n_tokens for r in unigram.count_tokens(documents(rows), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) if t else 0 for i, t in rows}


def test_ties_go_as_in_the_library():
    vocab = [("<unk>", -20.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), (unigram.MARK, -1.0)]
    library, counter = library_of(vocab, False), unigram.UnigramCounter(vocab)
    for _ in range(300):
        text = "".join(random.choice("abx ") for _ in range(20))
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
