"""Packing against the rule tried gap by gap, and every piece against the tokenizers library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dossierlake.llm import bpe, packing as p


def by_rule(lengths, room):
    """Each length where the sum of squares is smallest, among open sequences, of equal sums the tightest gap."""
    opened = []
    for length in lengths:
        gaps = sorted({g for g in opened if g >= length})

        def squares(gap, length=length):
            after = list(opened)
            after.remove(gap)
            after.append(gap - length)
            return sum(sum(1 for g in after if g == kind) ** 2 for kind in set(after) if kind > 0)

        if gaps:
            gap = min(gaps, key=squares)
            opened.remove(gap)
        else:
            gap = room
        opened.append(gap - length)
    return sorted(opened)


def test_rule():
    draw = random.Random(2)
    for room in (8, 20, 50):
        for _ in range(40):
            lengths = [draw.randint(1, draw.choice([3, room])) for _ in range(draw.randint(0, 40))]
            if draw.random() < 0.5:
                lengths.sort(reverse=True)
            sequence, offset = p.sum_of_squares(np.array(lengths, np.int64), room)
            fill = defaultdict(int)
            for s, o, length in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
                assert o == fill[s]
                fill[s] += length
            assert sorted(room - f for f in fill.values()) == by_rule(lengths, room)


def test_nearly_no_waste():
    lengths = np.sort(np.random.default_rng(0).lognormal(6, 1.2, 20_000).astype(np.int64) % 2047 + 1)[::-1]
    sequence, _ = p.sum_of_squares(lengths, 2048)
    assert sequence.max() + 1 <= -(-lengths.sum() // 2048) + 2


def checked(rows, room):
    """Sequences have no gaps or overlaps and no more than ``room``."""
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= room
    return held


def test_groups_and_odd_rows(spark, documents):
    vocabulary = bpe.share_vocabulary(spark, bpe.vocabulary_path())
    rows = [(1, None), (2, ""), (2, ""), (None, "word " * 3000), (3, "word " * 31), (4, "word " * 32), (5, "word " * 63)] + [(i, "a b c " * (i % 9)) for i in range(10, 200)]
    docs = documents(rows, length=F.lit("clash"), ids=F.lit(1), row=F.lit(2), offset=F.lit(3), item=F.lit(4), key=F.lit(5)).repartition(4)
    pieces = p.cut(docs, vocabulary, room=32)
    packed = p.pack(pieces, room=32, group=50)
    rows_out = packed.select("item.row.doc_id", "item.length", "item.piece", "item.start", "item.ids", "sequence_id", "offset").collect()
    held = checked(rows_out, 32)
    total = sum(r["length"] for r in rows_out)
    assert total == sum(len((t or "").split()) + 1 for _, t in rows)
    assert len(held) <= -(-total // 32) + 4 * 2
    assert sorted((r["piece"], r["start"], r["length"]) for r in rows_out if r["doc_id"] is None) == [(i, 32 * i, 32 if i < 93 else 25) for i in range(94)]
    assert [(r["length"], r["ids"]) for r in rows_out if r["doc_id"] == 1] == [(1, bytes(4))]
    assert sorted(r["length"] for r in rows_out if r["doc_id"] in (3, 4, 5)) == [1, 32, 32, 32, 32]
    joined = {r["sequence_id"]: r["ids"] for r in p.sequences(packed).collect()}
    for r in rows_out:
        assert bytes(joined[r["sequence_id"]])[4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert p.pack(pieces.limit(0), room=32).count() == 0


def test_lengths_out_of_range_end_the_job(spark):
    for value in ("0", "33", "null"):
        with pytest.raises(PySparkException, match="not a length"):
            p.pack(spark.sql(f"SELECT {value} AS length"), room=32).collect()


def test_bytes_that_are_not_utf8(spark):
    docs = spark.sql("SELECT 1L AS doc_id, cast(unhex('61FF20') AS string) AS text")
    library = Tokenizer.from_file(bpe.vocabulary_path())
    row = p.cut(docs, bpe.share_vocabulary(spark, bpe.vocabulary_path())).first()
    assert bpe.token_ids(row["ids"]) == [*library.encode("a� ", add_special_tokens=False).ids, 0]


def test_query(spark, sf_dir):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = p.query(spark, sf_dir).collect()
    assert p.query(spark, sf_dir).dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    want = {}
    for i, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    held = checked(rows, 2048)
    assert len(held) <= -(-sum(w[1] for w in want.values()) // 2048) + 2
