"""Fingerprints and groups against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dossierlake.llm import simhash as s
from dossierlake.llm.components import connected_components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Component of each position by trying all pairs."""
    f, root = np.array(prints, np.uint64), list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]) <= 3) + i + 1:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(f))]


def texts():
    draw = random.Random(1)
    out = ["", None, " \t\n", "one", "one two", "ONE Two", "one two three", "É é x y", "word " * 30000, "a b c " * 5]
    for _ in range(60):
        base = [f"w{draw.randint(0, 5000)}" for _ in range(draw.randint(4, 300))]
        out.append(" ".join(base))
        for _ in range(draw.randint(0, 3)):
            near = base[:]
            near[draw.randrange(len(near))] = "changed"
            out.append("  ".join(near))
    return out


def test_fingerprints_and_groups(documents):
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts())] + [(1000, "one"), (1000, "one"), (None, "one two")]
    found = s.near_duplicates(documents(rows, fp=F.lit("clash"), id=F.lit(1), component_id=F.lit(2))).collect()
    prints = [fingerprint(t) for _, t in rows]
    roots = groups(prints)
    smallest = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            smallest[r] = min(smallest.get(r, i), i)
    want = sorted(((i, p, smallest.get(r, i)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=str)
    assert sorted(((r["id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in found), key=str) == want


def test_same_hash_as_spark(spark):
    frame = spark.createDataFrame([("some é words here",)], "t string")
    assert frame.select(F.xxhash64("t")).first()[0] & (2**64 - 1) == xxhash.xxh64_intdigest("some é words here".encode(), 42)


@pytest.mark.parametrize(("blocks", "slot"), [(4, 16), (5, 2048), (6, 50)])
def test_links_connect_what_is_near(spark, blocks, slot):
    """A dense group, chains and strangers, with small slots so that buckets are cut."""
    draw = random.Random(blocks)
    prints = {0, 2**64 - 1}
    center = draw.getrandbits(64)
    for _ in range(400):
        x = center
        for b in draw.sample(range(64), draw.randint(0, 4)):
            x ^= 1 << b
        prints.add(x)
    chain = draw.getrandbits(64)
    for _ in range(60):
        for b in draw.sample(range(64), 3):
            chain ^= 1 << b
        prints.add(chain)
    prints |= {draw.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    frame = spark.createDataFrame([(s._signed(p),) for p in prints], "fp long").repartition(4)
    made = s.links(frame, blocks, slot)
    assert made.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    found = {r["node"]: r["root"] for r in connected_components(made).collect()}
    roots = groups(prints)
    ours, theirs = {}, {}
    for p, r in zip(prints, roots, strict=True):
        ours.setdefault(found.get(s._signed(p), s._signed(p)), set()).add(p)
        theirs.setdefault(r, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, theirs.values()))


def test_empty(documents):
    assert s.near_duplicates(documents([(1, "a")]).limit(0)).count() == 0


def test_components(spark):
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(draw.randint(200, 400), draw.randint(200, 400)) for _ in range(120)] + [(7, 7), (161, 161)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {x: r for x, r in root.items() if x != r}


def test_bytes_that_are_not_utf8(spark):
    """A bad byte counts as U+FFFD."""
    docs = spark.sql("SELECT id AS doc_id, cast(unhex(h) AS string) AS text FROM VALUES (1L, '61FF62'), (2L, '61EFBFBD62'), (3L, '6162') AS t(id, h)")
    found = {r["id"]: r["component_id"] for r in s.near_duplicates(docs).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
