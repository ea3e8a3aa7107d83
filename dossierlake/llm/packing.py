"""Packing documents into sequences of bounded length by sums of squares.

Open sequences are counted by the room that is left in them, their gap. A piece goes where the sum of the squared counts is
smallest afterwards, so gaps stay varied and later pieces find one that fits; the longest pieces come first, and a sequence is
opened only when no open one has room. Only keys and lengths travel: they are dealt to groups of bounded size, each packed in
a task of its own, and a group costs about one sequence more than its tokens need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import bpe
from dossierlake.llm.buckets import whole_groups
from dossierlake.llm.common import stored, table

#: Tokens of a sequence.
ROOM = 2048
#: About how many pieces are packed together in one task.
GROUP = 1 << 17
#: Fixed value: the token that ends each document.
END = 0


def cut(docs: DataFrame, vocabulary, room: int = ROOM, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all), ``piece``, ``start``, ``length`` and ``ids`` of each piece.

    A document is its token ids, then END; null texts are empty, so every row has a piece. Only documents longer than
    ``room`` are cut, and only their last piece may be shorter. ``ids`` are little-endian unsigned 32-bit numbers.
    """
    coded = bpe.encode(docs, vocabulary, text_col, keep)
    closed = coded.select("row", (F.col("n_tokens") + 1).alias("total"), F.concat("ids", F.lit(END.to_bytes(4, "little"))).alias("ids"))

    def piece(i):
        length = F.least(F.lit(room).cast("long"), F.col("total") - i * room)
        part = F.substring(F.col("ids"), (i * (4 * room) + 1).cast("int"), (4 * length).cast("int"))
        return F.struct(i.cast("int").alias("piece"), (i * room).alias("start"), length.alias("length"), part.alias("ids"))

    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / room).cast("long")), piece)
    return closed.select("row", F.inline(parts))


def sum_of_squares(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length, taken in the given order. Lengths are from 1 to ``room``."""
    counts = np.zeros(room + 1, np.int64)
    open_: list[list[int]] = [[] for _ in range(room + 1)]
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = 0
    for at, length in enumerate(lengths.tolist()):
        left = np.flatnonzero(counts[length:])  # the gaps that would be left
        if len(left):
            # From counts x at the gap and y at what is left of it, the sum changes by 2 * (y - x) + 2; full ones do not count.
            change = 2 * (counts[left] - counts[left + length]) + 2
            if left[0] == 0:
                change[0] = 1 - 2 * counts[length]
            gap = int(left[change.argmin()]) + length
            counts[gap] -= 1
            number = open_[gap].pop()
        else:
            gap, number = room, opened
            opened += 1
        sequence[at], offset[at] = number, room - gap
        if gap > length:
            counts[gap - length] += 1
            open_[gap - length].append(number)
    return sequence, offset


def pack(items: DataFrame, length: str = "length", room: int = ROOM, group: int = GROUP) -> DataFrame:
    """``item`` (the columns of ``items``), ``sequence_id`` and ``offset`` of each row.

    The column ``length`` holds 1 to ``room``; another value, or null, ends the job. Rows of ``room`` have a sequence of their
    own (with a negative number). Rows may repeat and the table may be empty. Items are written once, which fixes their keys;
    groups are filled by the hash of the key, so they are of one size whatever the data.
    """
    spark = items.sparkSession
    size = F.col(f"`{length}`").cast("long")
    fits = F.when(size.between(1, room), size).otherwise(F.raise_error(F.concat(F.lit(f"not a length from 1 to {room}: "), F.coalesce(size.cast("string"), F.lit("null")))).cast("long"))
    keyed = stored(items.select(F.struct(*[F.col(f"`{c}`") for c in items.columns]).alias("item"), fits.alias("length"), F.monotonically_increasing_id().alias("key")), "packed-items")
    short = keyed.filter(F.col("length") < room).select("key", "length")
    groups = max(1, -(-short.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["group"]):
            for begin, end in zip(bounds, bounds[1:], strict=False):
                part = rows.slice(int(begin), int(end - begin)).combine_chunks()
                sequence, offset = sum_of_squares(part.column("length").to_numpy(), room)
                number = part.column("group").to_numpy() * (1 << 40) + sequence
                yield pa.RecordBatch.from_arrays([part.column("key").combine_chunks(), pa.array(number, pa.int64()), pa.array(offset, pa.int64())], ["key", "sequence_id", "offset"])

    dealt = short.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups))).repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "key")
    placed = stored(dealt.mapInArrow(run, "key long, sequence_id long, offset long"), "placed")
    return keyed.join(placed, "key", "left").select("item", F.coalesce("sequence_id", -1 - F.col("key")).alias("sequence_id"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and the joined ``ids`` of each sequence; ``item`` carries ``ids``. A sequence never holds more than its room."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.col("item.ids").alias("ids"))))
    joined = F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.share_vocabulary(spark, bpe.vocabulary_path())
    pieces = cut(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])
    packed = pack(pieces.select("row.doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packed.select("item.*", "sequence_id", "offset")
