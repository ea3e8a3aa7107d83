"""Encoding and decoding against the tokenizers library."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossierlake.llm import bpe

PATH = bpe.vocabulary_path()
ODD = ["", " ", "\n\t", "a", "aaaaaaa" * 30, "!" * 200, "ha" * 99 + "h", "x" * 5000, "<|endoftext|> a<|startoftext|>", "I'LL don't ΣΑΣ İẞK", "éé \x1c\x85 a", "🙂中文ﬁ"]


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, encoding="utf-8").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def drawn(n):
    draw, letters = random.Random(3), "aabést ñ'ls\x1c\x85ΣİK<|>中🙂!.019\n\t​"
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, 80))) for _ in range(n)]


def test_matches_library(codec, library):
    decoder = bpe.Decoder(open(PATH, encoding="utf-8").read())
    assert decoder.decode(np.array([10**6, 320], "<u4")) == library.decode([320])
    texts = ODD + drawn(5000)
    for text, ids, real in zip(texts, codec.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == real.ids, text
        assert decoder.decode(np.frombuffer(ids, "<u4")) == library.decode(real.ids, skip_special_tokens=False)


def test_small_cache_and_long_words(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 5)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 5)
    monkeypatch.setattr(bpe, "GROUP", 50)
    codec = bpe.Codec(open(PATH, encoding="utf-8").read())
    texts = ODD + drawn(300)
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pair_check_agrees_with_merging(codec):
    draw = random.Random(5)
    bodies = [c for c in codec.vocab if not c.endswith("</w>")]
    ends = [c for c in codec.vocab if c.endswith("</w>") and len(c) > 4]
    pairs = [(draw.choice(bodies), draw.choice(ends)) for _ in range(3000)] + [("a" * n, "a</w>") for n in (1, 2, 3) if "a" * n in codec.vocab]
    got = codec.compatible(*(np.array([codec.vocab[p[i]] for p in pairs], np.int64) for i in (0, 1)))
    want = [codec.merged(x + y[:-4]) == [codec.vocab[x], codec.vocab[y]] for x, y in pairs]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_short_and_long_merging_agree(codec, monkeypatch):
    words = [w for t in drawn(200) for w in codec.split(t) if isinstance(w, str)]
    spelled = [w.encode().decode("latin-1").translate(codec.letters) for w in words]
    short = [codec.merged(s) for s in spelled]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert [codec.merged(s) for s in spelled] == short


def test_frame(spark, documents, library):
    vocabulary = bpe.share_vocabulary(spark, PATH)
    texts = [*ODD, None, *ODD]
    docs = documents([(i, t) for i, t in enumerate(texts)], ids=F.lit("clash"), n_tokens=F.lit(-1), row=F.lit(0))
    rows = bpe.decode(bpe.encode(docs, vocabulary), vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        real = library.encode(texts[r["row"]["doc_id"]] or "", add_special_tokens=False)
        assert bpe.token_ids(r["ids"]) == real.ids and r["n_tokens"] == len(real.ids)
        assert r["decoded"] == library.decode(real.ids, skip_special_tokens=False) and r["row"]["ids"] == "clash"
    assert bpe.encode(docs.filter("doc_id < 0"), vocabulary).count() == 0


def test_query(spark, sf_dir, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = bpe.query(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        real = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(real) and r["ids_sha256"] == hashlib.sha256(np.array(real, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(real, skip_special_tokens=False).encode()).hexdigest()


def test_fast_words_are_the_words_of_the_vocabulary():
    """Every character of the first plane, between others and at both ends, is cut as the vocabulary's own pattern cuts it."""
    codec = bpe.Codec(open(bpe.vocabulary_path(), encoding="utf-8").read())
    plane = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x10000)]]
    text = "".join(c + x for c, x in zip(plane, itertools.cycle(["", "a", " ", "7", "'s", "é", "-", "\u0301"])))
    assert codec.plane_words.findall(text) == codec.words.findall(text)
    assert codec.cut("x\U0001d7d8\U00020000é y") == codec.words.findall(codec.normal("x\U0001d7d8\U00020000é y"))
