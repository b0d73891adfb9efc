"""Pieces against the tokenizer itself."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factorloom.llm import packing
from factorloom.llm.common import WordMemory

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers():
    rng = random.Random(5)
    bits = ["'s", "'t", "ab", "é", "é", "́", " ", "\n", ".", ",", "A", "İ", "Σ", "ς", "ǅ", "<|endoftext|>", "\t", "\x85", "日本", "🙂"]
    bits += ["1", "12", "x.", "y,", "I'LL", "ﬁ", "K", "!!", "###", "-", "_", "(", '"', "\u0958", "."]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(4000)] + ["", "a" * 5000]
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert words(texts) == want
    assert words(texts[:100]) == want[:100]


@pytest.mark.parametrize(("n", "want"), [(1, [1]), (13, [8, 4, 1]), (4096, [4096]), (9000, [4096, 4096, 512, 256, 32, 8])])
def test_cut(n, want):
    assert packing.cut(n) == want


def test_every_id_in_one_piece(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    plain = Tokenizer.from_file(PATH)
    want = {r["doc_id"]: [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    got = packing.pieces(docs, PATH, 2).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append(r)
        assert r["offset"] == 0 and r["length"] == len(r["ids"]) == r["bucket"] and r["length"] & (r["length"] - 1) == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    assert len({r["sequence_id"] for r in got}) == len(got)
    for i, ids in want.items():
        own = sorted(parts[i], key=lambda r: r["start"])
        assert [x for r in own for x in r["ids"]] == ids
        assert all(r["doc_tokens"] == len(ids) for r in own)


def test_edge_cases(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0), (None, "", 0), (2, "a b", 0), (2, "a b", 0)], "doc_id long, text string, Length int")
    got = packing.pieces(df, PATH, 2)
    assert sorted((r["doc_tokens"] for r in got.collect())) == [1, 1, 3, 3, 3, 3]
    assert packing.pieces(df.limit(0), PATH, 2).collect() == []
    with pytest.raises(ValueError):
        packing.pieces(df, PATH, 2, longest=100)
    packing.write_buckets(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.filter(F.col("bucket") != F.size("ids")).count() == 0 and back.count() == 6


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello, World! It's  10 o'clock\n\nagain ", "", "\u00e9A b"]
    plain = Tokenizer.from_file(path)
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    words = packing.WordIds(path)
    assert not words.by_words and words(texts) == want


def test_memory_is_bounded_by_bytes():
    memory = WordMemory(100_000)
    for k in range(50):
        new = {f"word{k}-{j}" for j in range(100)} | {"x" * 5000 + str(k)}
        for w in memory.missing(new):
            memory.put(w, b"1234")
        assert new <= set(memory.newer)
    assert memory.size <= 100_000 and len(memory.older) < 400 and sum(len(w) > 200 for w in memory.newer) == 1


def test_letters_by_the_model_have_the_tokenizers_ids(monkeypatch):
    """Words of letters go to the model itself, without the tokenizer's normalization of whole texts."""
    encode = packing.WordIds(PATH)
    words = ["the", "Queanç", "ÉTÉ", "straße", "ΣΟΦΟΣ", "Ёлка", "İstanbul", "e\u0301te\u0301", "日本", "ﬁn", "ꟋA", "unbelievablement"]
    want = [array("I", encode.tokenizer.encode(w, add_special_tokens=False).ids).tobytes() for w in words]
    each = encode._each
    asked = []
    monkeypatch.setattr(encode, "_each", lambda some: asked.extend(some) or each(some))
    assert encode.letters([w.lower() if w.isascii() else w for w in words]) == want
    assert not {"the", "Queanç", "ÉTÉ", "straße", "ΣΟΦΟΣ", "Ёлка", "unbelievablement"}.intersection(asked)


def test_added_tokens_in_capitals_are_text():
    """Only what is an added token as it stands is one, whatever its small form."""
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|>. B", "x<|endoftext|>Y <|ENDOFTEXT|>", "No ONE, no one."]
    words, plain = packing.WordIds(PATH), Tokenizer.from_file(PATH)
    want = [array("I", plain.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert words(texts) == want


def test_each_word_is_encoded_once(monkeypatch):
    """Capitals and punctuation make no further words of a text of Latin-1 characters."""
    encode = packing.WordIds(PATH)
    learn, asked = encode._learn, []
    monkeypatch.setattr(encode, "_learn", lambda parts: asked.extend(parts) or learn(parts))
    texts = ["The the, THE. tHe!!!\nthe\n", "", " ", "ÉTÉ été the%%% {the", "the, «the» e.g. THE,!!"]
    want = [array("I", encode.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    assert encode(texts) == want
    assert sorted(asked) == sorted(["the", ",", ".", "!!!", "été", "%%%", "{the", "«the»", "e", ".g", ",!!"])
    assert encode([]) == [] and encode([""]) == [b""]
    asked.clear()
    assert encode(texts) == want and asked == []
