"""Byte-level BPE against the tiktoken library itself."""

import hashlib
import random

import public_tokenizers
import pytest
from lexiscope.llm import byte_bpe_ids as bb

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = ["", " ", "   ", "\n", "a\n\nb", "  a  b ", "a<|endoftext|>b", "don't we'LL", "՘x'", "x₏", "\U0001F600 ok", "a\x00b", "x" * 5000, ");\r\n\t", "﻿x", "é", "\x1c\x85 x", "'\U00032400s", "ab" * 30000]
PARTS = ["a", "the", " ", "  ", "\n", "\r\n", "\t", "é", "́", "<|endoftext|>", "12", "'s", "　", "\U0001F600", "!?", "՘", "\U00032400", "\U00011de1", "中文", " naturally", "ing"]


def library(path=RANKS):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bb.read_ranks(path), special_tokens={})


def texts(n=400, seed=5):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_digests(spark, name):
    path = public_tokenizers.path(name)
    own = library(path)
    rows = list(enumerate(texts())) + [(None, None), (0, ODD[0]), (1, "again"), (1, "again")]
    df = spark.createDataFrame([(i, t, 1, {"a": 2}) for i, t in rows], "doc_id long, text string, n_tokens int, `a.b` map<string,int>").repartition(3)
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bb.encode_decode(df, path, PATTERN).collect()), key=str) == sorted(want, key=str)
    assert bb.encode_decode(df.limit(0), path, PATTERN).count() == 0


def test_ids_and_bytes(spark):
    own = library()
    df = spark.createDataFrame(list(enumerate(texts(100, 6))), "doc_id long, text string")
    for r in bb.encode_decode(df, RANKS, PATTERN, digests=False).collect():
        text = texts(100, 6)[r.doc_id]
        assert r.ids == own.encode_ordinary(text) and bytes(r.decoded).decode() == text


def test_every_character_is_cut_alike():
    """The cutter and the library see the same boundaries around every character."""
    import tiktoken

    classes = [tiktoken.Encoding(p, pat_str=p, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={}) for p in (r"\p{L}", r"\p{N}", r"\s")]
    cut, stand_ins = bb.Cutter(PATTERN), "é1　"
    for cp in (*range(0xD800), *range(0xE000, 0x33500), *range(0x3FC00, 0x40000), 0xE0100, 0x10FFFF):
        c = chr(cp)
        kind = next((s for s, k in zip(stand_ins, classes, strict=True) if k.encode_ordinary(c)), "!")
        text = f"a{c}1{c} {c}{c}!{c}"
        assert list(map(len, cut(text))) == list(map(len, cut.cut.findall(text.replace(c, kind) if c not in "a1 !" else text))), hex(cp)


def test_model_follows_ranks():
    """Merges go by rank, leftmost first, and a pre-token that is a token is that token though no merge makes it."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 300, b"xyz": 301, b"aa": 302}
    codec = bb.RankCodec(bb.sentencepiece_model(ranks), PATTERN)
    assert codec.encode(["abc", "abcd", "bcab", "xyz", "xyzx", "aaaaa"]) == [[300], [300, 100], [257, 256], [301], [120, 121, 122, 120], [302, 302, 97]]
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert all(codec.encode([t])[0] == own.encode_ordinary(t) for t in ("abc", "abcd", "bcab", "xyz", "xyzx", "aaaaa", "abbcaab"))
    with pytest.raises(ValueError, match="rank"):
        bb.sentencepiece_model({b"a": 0})


@pytest.mark.parametrize("most", [1, 10])
def test_table_is_bounded(monkeypatch, most):
    monkeypatch.setattr(bb, "MOST_KEPT", most)
    codec, own = bb.RankCodec(bb.sentencepiece_model(bb.read_ranks(RANKS)), PATTERN), library()
    for t in texts(50):
        assert codec.apply(t)[1] == " ".join(map(str, own.encode_ordinary(t)))
        assert len(codec.table) <= most and not any(len(p) > bb.LONGEST_KEPT for p in codec.table)
