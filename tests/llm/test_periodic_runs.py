"""Runs against all lags tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import periodic_runs as p


def expected(words):
    """All runs of a list of words: each lag by itself, smallest periods only."""
    code = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids, n, found = np.array([code[w] for w in words]), len(words), []
    for q in range(1, n // 4 + 1):
        same = np.concatenate(([False], ids[:-q] == ids[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for start, end in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            length = end - start + q
            if length >= max(6, 4 * q):
                part = ids[start : start + length]
                if not any((part[d:] == part[:-d]).all() for d in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % period] for i, w in enumerate(words)]


def result(doc_id, text):
    words = rewritten(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = expected(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if found else None,
        "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in found)),
        "collapsed_sha256": sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    }


def sequences():
    draw = random.Random(1)
    for _ in range(300):
        yield [draw.randint(0, draw.choice([1, 2, 3])) for _ in range(draw.randint(0, 90))]
    for _ in range(100):  # repeated parts, also nested ones, between noise
        out = []
        for _ in range(draw.randint(1, 4)):
            part = [draw.randint(0, 5) for _ in range(draw.randint(1, 9))] * draw.randint(1, 6)
            out += (part + [draw.randint(6, 9)]) * draw.randint(1, 5)
        yield out
    a, b = [0], [0, 1]
    for _ in range(11):
        a, b = b, b + a
    yield b
    yield [0] * 3000
    yield [i % 700 for i in range(3000)]
    for n in (5, 6, 7):
        yield [1] * n
    yield [1, 2] * 4
    yield [1, 2, 1, 2, 1, 2, 1]


def test_runs_match_all_lags():
    for words in sequences():
        ids = np.array(words, np.int64)
        assert [tuple(r) for r in p.runs(ids).tolist()] == expected(words), words


def test_work_grows_with_the_words(monkeypatch):
    """Repeated extensions are suppressed: a text of one word, or of one long period, is extended once per lag."""
    calls = []
    real = p._matching
    monkeypatch.setattr(p, "_matching", lambda *a: calls.append(a[2]) or real(*a))
    for ids in (np.zeros(100_000, np.int64), np.arange(100_000) % 20_000):
        calls.clear()
        assert len(p.runs(ids)) == 1 and len(calls) <= 2
    assert sum(len(where) for where, _ in p.seeds(np.tile(np.arange(50), 4000))) < 20 * 200_000


def test_odd_rows(spark, documents):
    long = "w x y z " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "a a a a a a"), (4, "a a a a a a"), (None, "b b b b b b c"), (5, long), (6, "é\x85\xa0é " * 9), (7, "no run here")]
    docs = documents(rows, runs=F.lit(1), collapsed=F.lit("x"), row=F.lit(2), period=F.lit(3), _tile_=F.lit(4)).repartition(3)
    got = sorted(((r["row"]["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in p.periodic_runs(docs).collect()), key=str)
    assert got == sorted([
        (1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 6, 1)], "a"), (4, [(0, 6, 1)], "a"), (None, [(0, 6, 1)], "b c"),
        (5, [(0, 160_000, 4)], "w x y z"), (6, [(0, 9, 1)], "é\x85\xa0é"), (7, [], "no run here")], key=str)
    assert p.periodic_runs(docs.filter("doc_id < 0")).count() == 0


def test_bytes_that_are_not_utf8(spark):
    """Each byte counts as it is: words that differ in a bad byte differ."""
    docs = spark.sql("SELECT id AS doc_id, cast(unhex(h) AS string) AS text FROM VALUES (1L, repeat('FF20', 6)), (2L, concat(repeat('FF20', 3), repeat('FE20', 3))) AS t(id, h)")
    got = {r["doc_id"]: (r["n"], r["hex"]) for r in p.periodic_runs(docs).select("row.doc_id", F.size("runs").alias("n"), F.hex(F.col("collapsed").cast("binary")).alias("hex")).collect()}
    assert got == {1: (1, "FF"), 2: (0, "FF20FF20FF20FE20FE20FE")}


@pytest.fixture
def tables(spark, folder, documents):
    def make(rows):
        path = folder("runs")
        documents(rows).write.parquet(f"{path}/documents.parquet")
        return path

    return make


def test_query_on_rewritten_texts(spark, tables):
    draw = random.Random(4)
    rows = [(i, " ".join(draw.choice("abcdefghij") for _ in range(draw.randint(0, 120)))) for i in range(300)] + [(1000, None)]
    got = [r.asDict() for r in p.query(spark, tables(rows)).collect()]
    assert sorted(got, key=lambda r: r["doc_id"]) == [result(i, t) for i, t in rows]


def test_query_on_documents(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r.asDict() for r in p.query(spark, sf_dir).collect()}
    assert sorted(got) == sorted(docs)
    short = [i for i, t in docs.items() if len(t or "") < 20_000]
    assert len(short) > len(docs) * 0.8
    for i in short:
        assert got[i] == result(i, docs[i])
