"""Exact duplicates: brute force, hash clashes, odd rows."""

import hashlib

from pyspark.sql import functions as F

from dossierlake.llm import exact_dedup as e

LONG = "".join(f"Sentence {i} of a long text. " for i in range(3000))
ROWS = [
    (1, "a"), (2, "a"), (3, "a "), (4, None), (5, ""), (6, LONG), (7, LONG), (8, LONG + "x"), (9, "x" + LONG), (10, "y" * 20000), (11, "y" * 20000), (12, "y" * 20001),
    (13, "A"), (2, "a"), (14, LONG.replace("Sentence 1500", "Sentence 15O0")), (15, "é\n.\n"), (None, "lone"), (None, "two"), (16, "two"),
]


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def got(frame):
    return sorted(map(tuple, frame.select("id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_brute_force(documents):
    docs = documents(ROWS, recipe=F.lit("clash"), id=F.lit(0), group_size=F.lit("x"))
    assert got(e.exact_duplicates(docs)) == expected(ROWS)


def test_clashing_hashes_are_told_apart(documents):
    weak = lambda c: F.pmod(F.xxhash64(c), F.lit(2))
    assert got(e.exact_duplicates(documents(ROWS), chunk_hash=weak)) == expected(ROWS)


def test_small_chunks_and_empty_table(documents):
    assert got(e.exact_duplicates(documents(ROWS), shortest=4, longest=16)) == expected(ROWS)
    assert e.exact_duplicates(documents(ROWS).limit(0)).count() == 0


def test_cuts_follow_content(documents):
    """A change in one place leaves most chunks as they were."""
    lists = [set(r["recipe"]) for r in e.recipes(documents([(1, LONG), (2, "Start. " + LONG)])).collect()]
    assert len(lists[0] & lists[1]) > 0.9 * len(lists[0]) > 20


def test_no_python_and_text_is_not_shuffled(documents):
    plan = e.exact_duplicates(documents(ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for line in plan.splitlines():
        assert "Exchange" not in line or "text#" not in line


def test_bytes_that_are_not_utf8(spark):
    """Texts are told apart by their bytes, also from the text that a bad byte is often shown as."""
    rows = [(1, "616263FF"), (2, "616263FE"), (3, "616263FF"), (4, "616263EFBFBD"), (5, "616263C3BF"), (6, "616263FF2E0A" * 900), (7, "616263FF2E0A" * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, h string").selectExpr("doc_id", "cast(unhex(h) AS string) AS text")
    found = {r["id"]: (r["keep_id"], r["group_size"], r["text_sha256"]) for r in e.exact_duplicates(docs).collect()}
    assert {i: f[:2] for i, f in found.items()} == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1), 5: (5, 1), 6: (7, 2), 7: (7, 2)}
    assert len({f[2] for f in found.values()}) == 5
