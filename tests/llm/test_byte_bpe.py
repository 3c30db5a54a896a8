"""Byte-level encoding and decoding against the tiktoken library."""

import hashlib
import random
import struct

import pytest
import tiktoken

from quarry.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.load(PATH, P.PATTERN, True)


@pytest.fixture(scope="module")
def library(bpe):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def test_matches_the_library(spark, documents, library):
    random.seed(9)
    texts = ["", "  ", " a", "\n\n a\t\tb ", "don't IT'S we'll", "<|endoftext|>x", "\x00\x1c\x1d\x85 ", "é 日本語テキスト 😀😀 ‍", "-" * 3000, "=" * 77 + " " * 999, "x1²Ⅷ½ 12345"]
    texts += ["".join(random.choice("aB'sS tT\n\x1c\x85é́-<|>x1²日😀") for _ in range(60)) for _ in range(300)]
    texts += ["word " * 40_000, "".join(random.choice("etaoin") for _ in range(3000)), "ab" * 5000]
    rows = [(i, t) for i, t in enumerate([*texts, None])] + [(3, texts[3])]
    encoded = byte_bpe.encode_documents(documents(rows), PATH, P.PATTERN, keep_ids=True).cache()
    got = encoded.collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert unpacked(bytes(r.ids)) == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == library.decode_bytes(ids)
        assert r.ids_sha256 == hashlib.sha256(bytes(r.ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    decoded = byte_bpe.decode_documents(encoded, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in decoded) == sorted((i, (t or "").encode()) for i, t in rows)


def test_each_token_encodes_to_itself(bpe):
    """What lets one step contract all disjoint pairs of the lowest rank, and windows join at common tokens."""
    tokens = [t for t in bpe.ranks if len(t) <= byte_bpe.WINDOW]
    assert [unpacked(ids) for ids, _ in bpe.encode_words(tokens)] == [[bpe.ranks[t]] for t in tokens]


def test_long_words_join_from_windows(bpe, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "WINDOW", 32)
    random.seed(4)
    tokens = list(bpe.ranks)
    words = [b"".join(random.choice(tokens) for _ in range(n)) for n in (1, 5, 20, 60) for _ in range(60)]
    words += [bytes(random.choice(b"ab ") for _ in range(300)) for _ in range(60)] + [b"a" * n for n in range(1, 200)]
    for word, (ids, decoded) in zip(words, bpe.encode_words(words), strict=True):
        assert unpacked(ids) == library._core_bpe.encode_single_piece(word) and decoded == word


def test_one_contraction_a_step(bpe, library):
    single = byte_bpe.ByteBpe(PATH, P.PATTERN, trained=False)
    words = [b"banana", b"aaaaaaa", b" the", b"x"]
    assert list(single.encode_words(words)) == list(bpe.encode_words(words))


def test_a_full_table_is_emptied(monkeypatch, library):
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(byte_bpe, "TEXT_CHARS", 50)
    small = byte_bpe.ByteBpe(PATH, P.PATTERN)
    texts = [f"some words {i} and {i * 7} more {'z' * i}" for i in range(100)]
    assert [unpacked(ids) for ids, _ in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_edges(spark, documents, bpe, tmp_path):
    assert byte_bpe.encode_documents(documents([(1, "a")]).limit(0), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError, match="not in the vocabulary"):
        bpe.decode([struct.pack("<I", 60_000)])
    assert bpe.decode([None, b"", struct.pack("<2I", 64, 65)]) == [b"", b"", b"ab"]
    lacking = tmp_path / "ranks"
    lacking.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError, match="no rank"):
        byte_bpe.ByteBpe(str(lacking), P.PATTERN)
