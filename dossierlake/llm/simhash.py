"""Near duplicates by SimHash fingerprints, with pivot distance tables.

Two fingerprints within ``RADIUS`` bits differ by at most ``RADIUS`` in their distance to any third one. The distances to
PIVOTS reference fingerprints are computed once per distinct fingerprint; a pair whose tables differ by more in any
coordinate is discarded, and survivors are verified bit by bit.

That filter halves the pairs with each pivot but does not say which pairs to look at. Fingerprints therefore meet in buckets:
the 64 bits are cut into BLOCKS, and of two fingerprints within RADIUS bits at least BLOCKS - RADIUS blocks are equal, so
one table per choice of that many blocks loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.buckets import dealt, meetings, near_pairs, whole_groups
from dossierlake.llm.common import pieces, stored, table
from dossierlake.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 3, 42
BLOCKS, PIVOTS = 5, 16
#: Rows of a bucket in a slot, and the group size from which a search replaces the comparison of all pairs at once.
SLOT, SMALL = 2048, 32
#: Shingles whose bits are counted together.
GROUP = 100_000


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def pivots() -> list[int]:
    """The reference fingerprints: hashes of their numbers."""
    return [xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(PIVOTS)]


def shingled(texts: list[str], shingle: int = SHINGLE) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Positions of texts that have words, where each one's shingles begin, and their hashes: about GROUP shingles at a time."""
    hashes: list[np.ndarray] = []
    owners: list[int] = []
    waiting = 0
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        width = min(shingle, len(words))
        spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
        hashes.append(np.fromiter([digest(joined[s:e], SEED) for s, e in spans], np.uint64))
        owners.append(i)
        waiting += len(hashes[-1])
        if waiting > GROUP:
            yield owners, np.cumsum([0] + [len(h) for h in hashes]), np.concatenate(hashes)
            hashes, owners, waiting = [], [], 0
    if hashes:
        yield owners, np.cumsum([0] + [len(h) for h in hashes]), np.concatenate(hashes)


def majority(starts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The fingerprints of texts whose shingles begin at ``starts`` (and end at the last of them)."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts[:-1], axis=0, dtype=np.int64)
    ones = counts * 2 > np.diff(starts)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    """SimHash of each text: a bit is 1 if set in over half the hashes of its shingles, repeats included."""
    out = np.zeros(len(texts), np.uint64)
    for owners, starts, hashes in shingled(texts, shingle):
        out[owners] = majority(starts, hashes)
    return out


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``fp`` (64 bits as a signed number) of each row."""
    narrow = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(fingerprints(texts).view(np.int64))], ["id", "fp"])

    return narrow.mapInArrow(run, T.StructType([narrow.schema["id"], T.StructField("fp", T.LongType())]))


def _masks(blocks: int) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, blocks - RADIUS)]


def _distances(first: int) -> Column:
    """Distances to eight pivots, a byte each."""
    bytes_ = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(p)))).cast("long"), 8 * i) for i, p in enumerate(pivots()[first : first + 8])]
    total = bytes_[0]
    for value in bytes_[1:]:
        total = total.bitwiseOR(value)
    return total


def _close(fp: np.ndarray, table_: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of positions within RADIUS bits: one coordinate of the tables after the other, then the bits."""
    for pivot in range(table_.shape[1]):
        if not len(a):
            return a, b
        stay = np.abs(table_[a, pivot] - table_[b, pivot]) <= RADIUS
        a, b = a[stay], b[stay]
    stay = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
    return a[stay], b[stay]


def _search(fp: np.ndarray, table_: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected in one group: reached fingerprints leave the search, so links stay few."""
    left = np.argsort(table_[:, 0], kind="stable")
    found_a, found_b = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            near = front[:64]
            front = front[64:]
            a, b = np.nonzero(np.abs(table_[near, 0][:, None] - table_[left, 0][None, :]) <= RADIUS)
            a, b = _close(fp, table_, near[a], left[b])
            if len(b):
                reached, first = np.unique(b, return_index=True)
                found_a.append(a[first])
                found_b.append(reached)
                left = left[~np.isin(left, reached)]
                front = np.concatenate((front, reached))
    return found_a, found_b


def links(prints: DataFrame, blocks: int = BLOCKS, slot: int = SLOT) -> DataFrame:
    """``a``, ``b``: links between the distinct fingerprints ``fp`` that connect all within RADIUS bits of each other.

    Of a dense group only as many links are returned as connect it: no pair within RADIUS is left unconnected.
    """
    named = prints.select("fp", _distances(0).alias("near"), _distances(8).alias("far"))
    keys = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_masks(blocks))])
    rows = named.select("fp", "near", "far", F.explode(keys).alias("k")).select("fp", "near", "far", "k.t", "k.key")
    tasks = dealt(meetings(rows, ["t", "key"], "fp", slot), ["t", "key"]).select("t", "key", "one", "two", "fp", "near", "far")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows_, bounds in whole_groups(batches, ["t", "key", "one", "two"]):
            fp = rows_.column("fp").to_numpy().view(np.uint64)
            packed = np.stack([rows_.column("near").to_numpy(), rows_.column("far").to_numpy()], axis=1).astype("<i8")
            table_ = packed.view(np.uint8).astype(np.int16)
            out_a, out_b = [], []
            for a, b in near_pairs(bounds, SMALL):
                a, b = _close(fp, table_, a, b)
                out_a.append(a)
                out_b.append(b)
            for group in np.flatnonzero(np.diff(bounds) > SMALL).tolist():
                begin, end = bounds[group], bounds[group + 1]
                a, b = _search(fp[begin:end], table_[begin:end])
                out_a += [x + begin for x in a]
                out_b += [x + begin for x in b]
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                pair = np.unique(np.stack([fp[a].view(np.int64), fp[b].view(np.int64)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return tasks.mapInArrow(run, "a long, b long")


def _rooted(prints: DataFrame, **options) -> DataFrame:
    """``fp``, ``first`` (its smallest ``id``), ``n`` (its rows) and ``root``, which linked fingerprints share, of each distinct one."""
    distinct = stored(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fp"), **options))
    return stored(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``fp`` and ``component_id``, the smallest id reachable over links.

    Null texts and texts without words have fingerprint 0 and link like any other. Equal fingerprints are one node, however
    many rows share them. Rows that repeat an id are rows of their own. Null ids never name a component that has another.
    """
    prints = stored(fingerprinted(docs, id_col, text_col), "fingerprints")
    rooted = _rooted(prints, **options)
    smallest = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("members")).filter("members > 1"), "components")
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp", "left").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
