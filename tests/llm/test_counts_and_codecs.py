"""Token counts and SentencePiece against the libraries themselves."""

import hashlib
import random

import public_tokenizers
import pytest
import regex
from lexiscope.llm import sentencepiece_ids as si
from lexiscope.llm import token_counts as tc

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "\n", "a\n\nb", "  a  b ", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", "don't we'll", "՘x", "€₏", "\U0001F600 ok", "▁a", "a\x00b", "<s>hi</s>", "x" * 5000, ");\r\n\t", "﻿x", "é"]
PARTS = ["a", "the", " ", "  ", "\n", "▁", "\r\n", "\t", "é", "́", "<|endoftext|>", "12", "'s", "　", "\U0001F600", "!?"]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ODD + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_token_counts(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    rows = list(enumerate(texts())) + [(-1, None), (0, ODD[0]), (0, ODD[0])]
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    want = sorted((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows)
    for frequent in (0, 5, tc.FREQUENT):
        assert sorted(map(tuple, tc.token_counts(df, BYTES, frequent=frequent).collect())) == want
    assert tc.token_counts(df.limit(0), BYTES).count() == 0


def test_each_pretoken_is_segmented_once(spark, monkeypatch):
    from collections import Counter

    from pyspark.sql import functions as F

    monkeypatch.setattr(tc, "HELD", 3)
    definition = spark.sparkContext.broadcast(open(BYTES).read())
    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").repartition(5).withColumn("n_bytes", F.lit(0))
    table = tc.pretoken_table(df, definition).collect()
    cutter, want = tc.PieceCounter(definition.value), Counter()
    for t in texts():
        want.update(cutter.frequencies(t)[0])
    assert {r.pretoken: (r.n, r.pieces) for r in table} == {k: (n, cutter.pieces([k])[0]) for k, n in want.items()}
    assert len(table) == len(want)


def test_character_classes_agree():
    """The pattern is used only on characters that the library classes alike."""
    from tokenizers import Tokenizer

    cutter, pattern, unsure = Tokenizer.from_file(BYTES).pre_tokenizer, regex.compile(tc.PATTERN), regex.compile(tc.UNSURE)
    for cp in range(0xA7CE):
        if 0xD800 <= cp <= 0xDFFF or unsure.match(chr(cp)):
            continue
        s = f"a{chr(cp)}1{chr(cp)} {chr(cp)}{chr(cp)}!{chr(cp)}\n"
        assert [x[1] for x in cutter.pre_tokenize_str(s)] == [m.span() for m in pattern.finditer(s)], hex(cp)


def test_other_tokenizers_fall_back(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(list(enumerate(["Hello World", "", "a b"])), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in tc.token_counts(df, path).collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(["Hello World", "", "a b"])}


def test_sentencepiece(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = list(enumerate(texts(seed=4))) + [(-1, None), (0, ODD[0])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, si.encode_decode(df, PIECES).collect())) == sorted(want)
    whole = {r.doc_id: (r.ids, r.decoded) for r in si.encode_decode(df.filter("doc_id > 0"), PIECES, digests=False).collect()}
    assert whole == {i: (library.encode(t), library.decode(library.encode(t))) for i, t in rows if i > 0}
    assert si.encode_decode(df.limit(0), PIECES).count() == 0


@pytest.mark.parametrize("most", [1, 10])
def test_table_is_bounded(monkeypatch, most):
    monkeypatch.setattr(si, "MOST_KEPT", most)
    codec = si.ChunkCodec(open(PIECES, "rb").read())
    for t in texts(50):
        codec.apply(t)
        assert len(codec.table) <= most
