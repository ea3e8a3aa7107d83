"""Mixing: targets against resharing step by step, draws against the definition."""

import math
import random

import pytest
from pyspark.sql import functions as F

from dossierlake.llm import mixing

DRAW = random.Random(4)
ROWS = [(i, "w " * (5 if i % 3 else DRAW.randint(0, 400)), f"s{i % 7}" if i % 4 else "s0") for i in range(3000)]
ROWS += [(3000, None, "s1"), (3001, "", None), (3002, "one two", None), (3003, "", "empty"), (7, "w w", "s1"), (7, "w w", "s1"), (None, "x y z", "s2"), (3004, "  a b\x0bc", "é")]


def reshared(sizes):
    """Targets by resharing the excess until none is above its cap."""
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    goal, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = goal - sum(capped.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 2 * sizes[s]]
        if not over:
            return capped | {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_targets_and_draw(documents):
    docs = documents(ROWS, size=F.lit("clash"), copies=F.lit(9), key=F.lit("k"))
    rows = mixing.sample(docs).collect()
    assert len(rows) == len(ROWS)
    sizes, taken, biggest = {}, {}, {}
    for r in rows:
        s = r["row"]["source"]
        size = len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r["row"]["text"] or "") if w])
        assert r["size"] == size and 0 <= r["copies"] <= 2
        sizes[s] = sizes.get(s, 0) + size
        taken[s] = taken.get(s, 0) + r["copies"] * size
        biggest[s] = max(biggest.get(s, 0), size)
    want = reshared(sizes)
    for r in rows:
        s = r["row"]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        rate = want[s] / sizes[s] if sizes[s] else 0
        assert math.floor(rate) <= r["copies"] <= math.ceil(rate + 1e-12)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * biggest[s] + 0.02 * want[s], s


def test_reruns_agree_whatever_the_partitions(documents):
    once, again = (mixing.sample(documents(ROWS).repartition(n), keep=["doc_id", "text"]).groupBy("row").agg(F.sum("copies").alias("n")) for n in (1, 9))
    assert once.exceptAll(again).count() == 0


def test_mix_repeats_rows(documents):
    docs = documents(ROWS[:500])
    drawn = {r["row"]["doc_id"]: r["copies"] for r in mixing.sample(docs).collect()}
    counts = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in drawn.items() if v}


def test_empty_and_wordless(documents):
    assert mixing.sample(documents(ROWS).limit(0)).count() == 0
    assert [r["copies"] for r in mixing.sample(documents([(1, None), (2, " ")])).collect()] == [0, 0]


def test_no_python(documents):
    plan = mixing.sample(documents(ROWS[:50]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_rows_without_an_id_are_spread(documents):
    """A third of all rows has no id: no window holds many of them, and each row is drawn as if one list held the source."""
    from hashlib import md5

    rows = [(i if i % 3 else None, f"u{i} " + "w " * (i % 5 * 40), "s0") for i in range(6000)] + [(i, f"{i} w", "s1") for i in range(6000, 6400)]
    cells = mixing._sized(documents(rows), "doc_id", "text", "source", ["doc_id"]).groupBy("key", "band", "slice", "cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 16

    ordered = {}
    for doc_id, text, source in rows:
        size = len(text.split())
        digits = md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()
        level = size.bit_length() * 32 + (size >> max(size.bit_length() - 5, 0))
        ordered.setdefault(source, []).append((level if level % 2 == 0 else 4097 - level, digits[:2], size, digits, -1 if doc_id is None else doc_id))
    sizes = {source: sum(item[2] for item in items) for source, items in ordered.items()}
    want, expected = reshared(sizes), []
    for source, items in ordered.items():
        rate, offset = want[source] / sizes[source], int(md5(f"mix:s{source}".encode()).hexdigest()[:8], 16) / 2**32
        for place, (*_, size, _, doc_id) in enumerate(sorted(items)):
            copies = min(math.floor((place + 1) * rate + offset) - math.floor(place * rate + offset), math.ceil(rate))
            expected.append((source, doc_id, size, copies))
    found = [(r["row"]["source"], -1 if r["row"]["doc_id"] is None else r["row"]["doc_id"], r["size"], r["copies"]) for r in mixing.sample(documents(rows)).collect()]
    assert sorted(found) == sorted(expected)
