"""Near copies: SimHash fingerprints list pairs, pivot tables discard them, the exact similarity of shingle sets decides.

Two texts are near copies if they share at least SIMILARITY of the distinct shingles of both (Jaccard). Their fingerprints
then differ in about a seventh of all bits, too many for a few equal blocks of bits to lose no pair: fingerprints meet in tables
of chosen bits, as many as a recall of RECALL at SIMILARITY asks for, of more bits the more texts there are. There the
distances to pivot fingerprints, the fingerprints and the sizes discard what cannot be near, and what stays is compared whole.

Rows with equal shingle sets are one class, however many they are. A pair is looked at in the first table it meets in. Shingle
sets are sent only to tasks in which the row has a partner that the sketches leave.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.buckets import dealt, meetings, near_pairs, whole_groups
from dossierlake.llm.common import pieces, slices, stored
from dossierlake.llm.components import connected_components
from dossierlake.llm.simhash import majority, pivots, shingled

SHINGLE, SIMILARITY = 5, 0.8
#: 64-bit words of a fingerprint; tables that share bits miss the same pairs, so 128 bits need half the tables that 64 do.
WORDS = 2
BITS = 64 * WORDS
#: The share of bits in which fingerprints of two texts at SIMILARITY differ: an angle, as of random planes.
TURNED = float(np.arccos(2 * SIMILARITY / (1 + SIMILARITY)) / np.pi)
#: A pair at SIMILARITY meets in a table so often, and lies within RADIUS bits but for very few.
RECALL, RADIUS = 0.98, 36
#: Rows a bucket has at most on average, rows of a bucket in a slot, and the group size from which rows are compared block by block.
BUCKET, SLOT, SMALL, BLOCK = 512, 1024, 32, 64
TASK = ["t", "key", "one", "two"]
#: Bytes of shingle sets that are put together at a time, but for larger groups.
SET_BYTES = 4 << 20


def tables(rows: int) -> np.ndarray:
    """The bits that each table compares, as masks of WORDS words a table, for so many distinct rows."""
    bits = max(0, int(np.ceil(np.log2(max(rows, 1) / BUCKET))))
    differ = np.arange(BITS + 1)
    often = np.array([comb(BITS, d) * TURNED**d * (1 - TURNED) ** (BITS - d) for d in differ.tolist()])
    apart = 1 - np.prod([(BITS - differ - i).clip(0) / (BITS - i) for i in range(bits)], axis=0) * np.ones(BITS + 1)
    count = 1
    while often @ apart**count > 1 - RECALL:
        count += 1
    # Every bit in one order after the other, so that tables share as few as they can.
    order, chosen = np.random.default_rng(42), np.zeros((count, BITS), np.uint8)
    for first in range(0, count, each := BITS // max(bits, 1)):
        spread = order.permutation(BITS)
        for table_ in range(first, min(first + each, count)):
            chosen[table_, spread[(table_ - first) * bits : (table_ - first + 1) * bits]] = 1
    return np.packbits(chosen, axis=1, bitorder="little").view("<u8")


def _pivots() -> np.ndarray:
    """The reference fingerprints: those of op7, lengthened."""
    longer = [[xxhash.xxh64_intdigest(f"pivot {i} {word}".encode()) for word in range(1, WORDS)] for i in range(len(pivots()))]
    return np.array([[first, *rest] for first, rest in zip(pivots(), longer, strict=True)], np.uint64)


def _hashed_again(hashes: np.ndarray, word: int) -> np.ndarray:
    """The shingle hashes that a word of the fingerprints counts: the first as they are, others mixed anew."""
    if not word:
        return hashes
    mixed = (hashes ^ hashes >> np.uint64(32)) * np.uint64(xxhash.xxh64_intdigest(f"word {word}".encode()) | 1)
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
    return mixed ^ mixed >> np.uint64(32)


def sketches(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Fingerprints (WORDS words each) and sorted distinct shingle hashes of each text; zeros and nothing where it has no words.

    Fingerprints are of the distinct shingles, as the similarity is.
    """
    fp = np.zeros((len(texts), WORDS), np.uint64)
    sets = [np.zeros(0, np.uint64)] * len(texts)
    for owners, starts, hashes in shingled(texts, SHINGLE):
        own = [np.unique(hashes[begin:end]) for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        for owner, distinct in zip(owners, own, strict=True):
            sets[owner] = distinct
        flat, bounds = np.concatenate(own), np.cumsum([0] + [len(x) for x in own])
        for word in range(WORDS):
            fp[owners, word] = majority(bounds, _hashed_again(flat, word))
    return fp, sets


def sketched(rows: DataFrame, with_sets: bool = False) -> DataFrame:
    """``place``, ``fp``, ``size`` and ``same`` (a hash of the shingle set) of rows of ``place`` and ``text``; ``shingles`` if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, "text"):
            fp, sets = sketches(texts)
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * WORDS)
            listed = pa.ListArray.from_arrays(offsets, pa.array(fp.reshape(-1).view(np.int64)))
            size = pa.array([len(x) for x in sets], pa.int64())
            raw = [x.tobytes() for x in sets]
            same = pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary())
            values, names = [piece.column("place"), listed, size, same], ["place", "fp", "size", "same"]
            if with_sets:
                values, names = [*values, pa.array(raw, pa.binary())], [*names, "shingles"]
            yield pa.RecordBatch.from_arrays(values, names)
        pa.default_memory_pool().release_unused()

    kinds = [("fp", T.ArrayType(T.LongType())), ("size", T.LongType()), ("same", T.BinaryType()), ("shingles", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["place"], *[T.StructField(*kind) for kind in kinds[: 4 if with_sets else 3]]]))


class _Sketches:
    """The sketches of the rows of some tasks, with the distances of each fingerprint to the pivots."""

    def __init__(self, rows: pa.Table, masks: np.ndarray) -> None:
        self.masks = masks
        self.met = rows.column("t").to_numpy()
        self.size = rows.column("size").to_numpy()
        self.fp = rows.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, WORDS)
        self.table = np.stack([np.bitwise_count(self.fp ^ pivot).sum(axis=1, dtype=np.uint8) for pivot in _pivots()], axis=1)
        # A byte less another, RADIUS added, is at most twice RADIUS where they differ by RADIUS at most, and wraps around otherwise.
        self.raised = self.table + np.uint8(RADIUS)

    def near(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of positions that may be near copies and do not meet in an earlier table."""
        stay = (self.raised[a] - self.table[b] <= 2 * RADIUS).all(axis=1)
        a, b = a[stay], b[stay]
        stay = np.bitwise_count(self.fp[a] ^ self.fp[b]).sum(axis=1, dtype=np.uint8) <= RADIUS
        return self._first(a[stay], b[stay])

    def near_block(self, begin: int, end: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for pairs of the rows from ``begin`` to ``end`` with later ones up to ``last``."""
        stay = np.ones((end - begin, last - begin), bool)
        for pivot in range(self.table.shape[1]):
            stay &= self.raised[begin:end, pivot][:, None] - self.table[begin:last, pivot][None, :] <= 2 * RADIUS
        differ = sum(np.bitwise_count(self.fp[begin:end, word][:, None] ^ self.fp[begin:last, word][None, :]) for word in range(WORDS))
        a, b = np.nonzero(stay & (differ <= RADIUS))
        later = a < b
        return self._first(a[later] + begin, b[later] + begin)

    def _first(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stay = np.minimum(self.size[a], self.size[b]) >= SIMILARITY * np.maximum(self.size[a], self.size[b])
        a, b = a[stay], b[stay]
        for table_ in range(int(self.met[a].max(initial=0))):
            stay = (self.met[a] <= table_) | ((self.fp[a] ^ self.fp[b]) & self.masks[table_]).any(axis=1)
            a, b = a[stay], b[stay]
        return a, b


def _partnered(batches: Iterator[pa.RecordBatch], masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of each task that have a partner there by their sketches."""
    for rows, bounds in whole_groups(batches, TASK):
        sketch, marked = _Sketches(rows, masks), np.zeros(rows.num_rows, bool)
        for a, b in near_pairs(bounds, SMALL):
            a, b = sketch.near(a, b)
            marked[a] = marked[b] = True
        for group in np.flatnonzero(np.diff(bounds) > SMALL).tolist():
            end = bounds[group + 1]
            for begin in range(bounds[group], end, BLOCK):
                a, b = sketch.near_block(begin, min(begin + BLOCK, end), end)
                marked[a] = marked[b] = True
        found = rows.select([*TASK, "number"]).filter(pa.array(marked))
        yield from found.to_batches()
    pa.default_memory_pool().release_unused()


def _shared(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many members of ``one`` each of the sets has."""
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(one, flat), max(len(one) - 1, 0))
    hit = one[at] == flat if len(one) else np.zeros(len(flat), bool)
    starts = np.cumsum([0] + [len(s) for s in sets])
    total = np.concatenate(([0], np.cumsum(hit)))
    return total[starts[1:]] - total[starts[:-1]]


def _linked(batches: Iterator[pa.RecordBatch], masks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Links that connect the near copies of each task: reached rows leave the search, so links stay few."""
    for rows, bounds in whole_groups(slices(batches, "shingles", SET_BYTES), TASK):
        sketch = _Sketches(rows, masks)
        sets = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in rows.column("shingles")]
        number, out_a, out_b = rows.column("number").to_numpy(), [], []
        for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            left, front = np.arange(begin, end), []
            while len(left):
                if not front:
                    front, left = [int(left[0])], left[1:]
                at = front.pop()
                _, b = sketch.near(np.full(len(left), at), left)
                if not len(b):
                    continue
                both = _shared(sets[at], [sets[i] for i in b.tolist()])
                reached = b[both >= SIMILARITY * (sketch.size[b] + sketch.size[at] - both)]
                out_a += [at] * len(reached)
                out_b += reached.tolist()
                left = left[~np.isin(left, reached)]
                front += reached.tolist()
        if out_a:
            yield pa.RecordBatch.from_arrays([pa.array(number[out_a]), pa.array(number[out_b])], ["a", "b"])
    # The worker serves other stages next.
    pa.default_memory_pool().release_unused()


def links(classes: DataFrame, texts: DataFrame, slot: int = SLOT) -> DataFrame:
    """``a``, ``b``: numbers of classes, so linked that near copies which meet in a table are connected.

    ``classes`` has ``number``, ``fp`` and ``size`` of one row of each class, ``texts`` has ``place`` (with ``number``) and ``text``.
    """
    masks = tables(classes.count())
    masked = F.posexplode(F.array(*[F.array(*[F.lit(word) for word in mask]) for mask in masks.view(np.int64).tolist()])).alias("t", "mask")
    key = F.xxhash64(*[F.col("fp")[word].bitwiseAND(F.col("mask")[word]) for word in range(WORDS)]).alias("key")
    placed = classes.select("number", "fp", "size", masked).select("number", "fp", "size", "t", key)
    tasks = dealt(meetings(placed, ["t", "key"], "number", slot), ["t", "key"])
    kind = "t int, key long, one int, two int, number long"
    marked = stored(tasks.select(*TASK, "number", "fp", "size").mapInArrow(lambda batches: _partnered(batches, masks), kind), "partnered")
    wanted = stored(marked.select("number").distinct(), "wanted")
    sets = sketched(texts.join(wanted, texts["place.number"] == wanted["number"], "left_semi"), with_sets=True)
    met = marked.join(sets.select(F.col("place.number").alias("number"), "fp", "size", "shingles"), "number")
    return dealt(met, ["t", "key"]).select(*TASK, "number", "fp", "size", "shingles").mapInArrow(lambda batches: _linked(batches, masks), "a long, b long")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slot: int = SLOT) -> DataFrame:
    """Of each group of near copies one row of ``docs``; rows that are near nothing else all stay.

    Texts are compared whole, with A-Z in lower case; one of fewer than SHINGLE words is one shingle, and null texts and texts
    without words are one group. Groups are what links of near copies connect. They are of rows, whatever their ids: rows
    without an id, or that share one, fall only if their texts are near another's. The row with the smallest id stays, one
    without an id only where no other has one, then the smallest hash of the text.
    """
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    # Numbers of rows hold only for what is written.
    rows = stored(docs.select(row.alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    place = F.struct(F.col(f"row.`{id_col}`").isNull().alias("nameless"), F.col(f"row.`{id_col}`").alias("id"), F.xxhash64(f"row.`{text_col}`").alias("hash"), "number")
    texts = rows.select(place.alias("place"), F.col(f"row.`{text_col}`").alias("text"))
    seen = stored(sketched(texts), "shingle-sketches")
    first = F.min(F.struct("place", "fp", "size")).alias("first")
    classes = stored(seen.groupBy("same").agg(first, F.count("*").alias("n")).select("same", "n", "first.*", F.col("first.place.number").alias("number")), "shingle-classes")
    roots = connected_components(links(classes.select("number", "fp", "size"), texts, slot)).withColumnRenamed("node", "number")
    rooted = stored(classes.select("place", "number").join(roots, "number", "left").withColumn("root", F.coalesce("root", "number")), "rooted")
    kept = stored(rooted.groupBy("root").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").select("root", F.col("first.number").alias("stays")), "kept")
    # Rows that fall are few where near copies are: texts then stay where they are.
    fallen = rooted.join(kept, "root").filter("number <> stays").select("number")
    copies = classes.filter("n > 1").select("same", F.col("number").alias("stays"))
    equal = seen.select("same", F.col("place.number").alias("number")).join(copies, "same").filter("number <> stays").select("number")
    return rows.join(stored(fallen.unionByName(equal), "fallen"), "number", "left_anti").select("row.*")
