"""Repeated lines: the perfect hash, and documents against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import line_dedup as d

SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def expected(rows, min_chars=40, min_docs=5):
    holders = defaultdict(list)
    for i, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    frequent = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        left = [line for line in lines if key(line) not in frequent or frequent[key(line)] == i]
        out.append((i, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(2)
    shared = [f"This line number {n} is long enough to count for É" + "x" * n for n in range(30)]
    shared += ["x" * 39, "y" * 40, "z" * 5000, "é" * 40]
    variants = [str, str.upper, lambda s: f" \t{s}\r", lambda s: s]
    rows = []
    for i in range(400):
        lines = [draw.choice(variants)(draw.choice(shared[: 3 + i % 31])) if draw.random() < 0.5 else f"own line {i} {draw.random()} and some more words" for _ in range(draw.randint(0, 12))]
        rows.append((i, "\n".join(lines + ["A line that every document holds, word for word."])))
    rows += [(400, None), (401, ""), (402, "\n\n"), (403, "A line that every document holds, word for word.\n" * 50), (5, rows[5][1]), (None, shared[0]), (None, rows[7][1])]
    return rows


def got(frame):
    return sorted(((r["row"]["doc_id"], r["n_lines"], r["n_dropped"], r["kept"]) for r in frame.collect()), key=str)


@pytest.mark.parametrize("shard_keys", [1, 100_000])
def test_brute_force(documents, shard_keys):
    rows = corpus()
    docs = documents(rows, lost=F.lit("clash"), n_lines=F.lit(1), id=F.lit(2)).repartition(5)
    assert got(d.drop_repeated_lines(docs, shard_keys=shard_keys)) == expected(rows)


def test_lost_lines_are_those_of_one_document(documents):
    """Rows without an id do not gather each other's lines."""
    line = lambda k: f"line {k} is long enough to count and many rows hold it"
    rows = [(None, f"{line(i % 50)}\n{line((i + 1) % 50)}\nrow {i}") for i in range(400)] + [(1000, "\n".join(map(line, range(50))))]
    lost = d.lost_lines(documents(rows)).collect()
    assert len(lost) == 400 and all(r["lost_id"] is None and len(r["lost"]) == 2 for r in lost)
    assert got(d.drop_repeated_lines(documents(rows, text_hash=F.lit("clash"), lost_hash=F.lit(1)))) == expected(rows)


def test_nothing_frequent_and_empty(documents):
    rows = [(i, f"a line of its own that is long enough to be counted {i}") for i in range(9)]
    assert got(d.drop_repeated_lines(documents(rows))) == expected(rows)
    assert d.drop_repeated_lines(documents(rows).limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    draw = np.random.default_rng(n)
    h1, h2 = draw.integers(0, 2**64, (2, n), np.uint64)
    h1[: n // 10] = h1[:1]  # equal first hashes are told apart by the second
    perfect = d.PerfectHash.build(h1, h2)
    assert sorted(perfect.find(h1, h2).tolist()) == list(range(n))
    absent = perfect.find(*draw.integers(0, 2**64, (2, 1000), np.uint64))
    assert absent.min() >= -1 and absent.max() < max(n, 1)
    assert len(perfect.words) * 64 < 5 * n + 64 * 40
