"""Phrases against plain counting in Python, and the query against its statement."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import collocations as c

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            totals[lang] += len(words)
            for k in range(1, 5):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, found in counts.items():
        candidates = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        gone = {p[i:j] for p, f in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * f >= 80 * found[p[i:j]]}
        ranked = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2000000 * a // (found[p[:k]] + found[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), found[p[:k]], found[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def drawn(draw, n):
    words = ["a", "b", "the", "The", "é", "ß", "İ", "x\x0by", "\x01", "p\x85q", "of", "new", "york", "\xa0z"]
    for _ in range(n):
        parts = []
        for _ in range(draw.randint(0, 30)):
            parts.append(draw.choice(["new york", "the state of new york", *words]))
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", " \x0b"]))
        yield "".join(parts), draw.choice(["en", "fr", None])


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("bits", [1 << 16, 64])
def test_against_counting(spark, monkeypatch, bits):
    """Also with a filter of 64 bits, which is full and lets everything pass."""
    monkeypatch.setattr(c, "LEAST_BITS", bits)
    monkeypatch.setattr(c, "MOST_BITS", bits)
    rows = [*drawn(random.Random(1), 400), (None, "en"), ("", None), ("word " * 5000, "long")]
    docs = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, phrase string").withColumns({"w1": F.lit(1), "f": F.lit(2), "n": F.lit(3)})
    got = sorted(tuple(r) for r in c.collocations(docs.repartition(5), least=4, top=25).select(*COLUMNS).collect())
    want = expected(rows, 4, 25)
    assert got == want and len(want) > 50
    assert ("long", 1, "word word word word", 4997, 5000, 4998, 5000, 999599) in got


def test_empty_table(spark, documents):
    assert c.collocations(documents([])).count() == 0 and c.collocations(documents([(1, None)])).count() == 0


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT cast(unhex(repeat('61FF2062202E', 9)) AS string) AS text, 'en' AS lang")
    rows = c.collocations(docs, least=3).select(F.hex(F.col("phrase").cast("binary")).alias("h"), "a").collect()
    assert [tuple(r) for r in rows] == [("61FF2062", 9)]


def test_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    counts = spark.createDataFrame([("en", p, len(p.split()), big + more) for p, more in (("a", 7), ("b", 5), ("a b", 3), ("a b c", 0), ("b c", 1), ("c", 9))], "lang string, phrase string, words int, f long")
    got = {r["phrase"]: (r["score"], r["longest"]) for r in c.scored(counts).collect()}
    assert got["a b"] == (2000000 * (big + 3) // (2 * big + 12), big) and got["a b c"] == (2000000 * big // (2 * big + 12), None)


def test_filter_has_what_it_was_given(spark):
    numbers = np.random.default_rng(0).integers(0, 1 << 48, 6000)
    frame = spark.createDataFrame([(n,) for n in numbers[:3000].tolist()], "number long")
    found = c.Filter(np.frombuffer(c.share_filter(frame).value, np.uint64))
    assert found.has(numbers[:3000].astype(np.uint64)).all() and found.has(numbers[3000:].astype(np.uint64)).mean() < 0.05


def test_query_matches_statement(spark, sf_dir):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = duck.execute(f"SELECT {', '.join(COLUMNS)} FROM ({c.ORACLE_SQL})").fetchall()
    assert sorted(tuple(r) for r in c.query(spark, sf_dir).select(*COLUMNS).collect()) == sorted(want) and want
