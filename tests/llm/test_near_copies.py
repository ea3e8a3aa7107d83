"""Near copies against all pairs, and their recall at the similarity promised."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import near_copies as n


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def groups(texts):
    """The smallest position that links of similarity 0.8 connect each position to."""
    sets, holders, root = [shingles(t) for t in texts], {}, list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        seen = {}
        for s in own or {None}:
            for j in holders.get(s, ()):
                seen[j] = seen.get(j, 0) + 1
            holders.setdefault(s, []).append(i)
        for j, both in seen.items():
            if not own or both >= 0.8 * (len(own) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def near(draw, words, similarity):
    """A copy with single words replaced until the next would fall below the similarity."""
    base, made = shingles(" ".join(words)), list(words)
    while True:
        tried = made[:]
        tried[draw.randrange(len(tried))] = f"new{draw.randint(0, 10**9)}"
        now = shingles(" ".join(tried))
        if len(base & now) < similarity * len(base | now):
            return made
        made = tried


def kept(documents, rows, **options):
    return sorted((r["doc_id"] for r in n.survivors(documents(rows), **options).collect()), key=str)


def test_recall_at_the_similarity(documents):
    draw, rows = random.Random(5), []
    for i in range(600):
        words = [f"w{draw.randint(0, 20_000)}" for _ in range(draw.randint(20, 300))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near(draw, words, 0.8)))]
    found = kept(documents, rows)
    assert [i for i in found if i % 2 == 0] == sorted(range(0, 1200, 2), key=str)
    assert sum(i % 2 for i in found) <= 0.05 * 600


def test_every_pair_of_a_small_table(documents):
    """Up to BUCKET texts are one bucket, so fingerprints and pivots see every pair."""
    draw, rows = random.Random(7), []
    for i in range(250):
        words = [f"w{draw.randint(0, 20_000)}" for _ in range(draw.randint(40, 300))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near(draw, words, 0.8)))]
    assert kept(documents, rows) == sorted(range(0, 500, 2), key=str)


@pytest.mark.parametrize("rows", [2_000, 231_000, 14_000_000])
def test_tables_find_fingerprints_at_the_similarity(rows):
    """Pairs of texts at 0.8 meet in a table of fingerprint bits; tables have more bits the more rows there are."""
    draw, masks = random.Random(rows), n.tables(rows)
    assert set(np.bitwise_count(masks).sum(axis=1).tolist()) == {int(np.ceil(np.log2(rows / n.BUCKET)))}
    texts = []
    for _ in range(300):
        words = [f"w{draw.randint(0, 20_000)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(near(draw, words, 0.8))]
    fp, _ = n.sketches(texts)
    differ = fp[::2] ^ fp[1::2]
    assert (np.bitwise_count(differ).sum(axis=1) <= n.RADIUS).all()
    assert ((differ[:, None, :] & masks[None]) == 0).all(axis=2).any(axis=1).mean() >= 0.95


@pytest.mark.parametrize("slot", [8, 1024])
def test_dense_group_and_strangers(documents, slot):
    """Many near copies of one text, in slots that cut their buckets, others below the similarity, and unlike ones."""
    draw = random.Random(slot)
    center = [f"c{i}" for i in range(200)]
    rows = [(1, " ".join(center))]
    for i in range(150):
        words = center[:]
        words[draw.randrange(200)] = f"x{i}"
        rows.append((2 + i, "  ".join(words).upper()))
    rows += [(1000 + i, " ".join(center[: 100 + i] + [f"y{i}z{j}" for j in range(100)])) for i in range(20)]
    rows += [(2000 + i, " ".join(f"q{i}r{j}" for j in range(draw.randint(1, 50)))) for i in range(60)]
    roots = groups([t for _, t in rows])
    assert kept(documents, rows, slot=slot) == sorted({rows[r][0] for r in roots}, key=str)


def test_odd_rows(documents):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(4, None), (3, ""), (5, " \n"), (6, "one"), (7, "ONE"), (None, "one two"), (None, "one two"), (8, long), (9, long + " more"), (8, long), (10, "other text")]
    assert kept(documents, rows, slot=16) == sorted([3, 6, None, 8, 10], key=str)


def test_empty_and_clashing_columns(documents):
    assert n.survivors(documents([(1, "a")]).limit(0)).count() == 0
    odd = documents([(1, "a b"), (2, "a b")], place=F.lit(1), fp=F.lit("x"), number=F.lit(2), same=F.lit(3), row=F.lit(4))
    found = n.survivors(odd)
    assert found.columns == odd.columns and [r["doc_id"] for r in found.collect()] == [1]
