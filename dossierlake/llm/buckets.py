"""Comparing rows inside buckets of any size in tasks of bounded size.

A bucket of n rows is cut into slots of at most LIMIT rows, and every two slots meet in one task. A task thus never holds
more than two slots, whatever the bucket, and the rows of a hot bucket spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import stored


def meetings(rows: DataFrame, bucket: list[str], member: str, limit: int) -> DataFrame:
    """``rows`` of buckets with two members or more, once per task they take part in, with ``slot``, ``one`` and ``two``.

    A task is named by the bucket and its two slots (``one`` <= ``two``). Buckets are counted map-side; the join with the
    counts may be split by size.
    """
    counted = stored(rows.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1"), "bucket-sizes")
    slots = F.ceil(F.col("n") / F.lit(limit)).cast("int")
    placed = rows.join(counted, bucket).withColumn("slots", slots).withColumn("slot", F.pmod(F.xxhash64(member, F.lit(7)), F.col("slots")).cast("int"))
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    return other.withColumn("one", F.least("slot", "other")).withColumn("two", F.greatest("slot", "other")).drop("n", "slots", "other")


def dealt(tasks: DataFrame, bucket: list[str]) -> DataFrame:
    """The rows of each task together and in order, many tasks to a partition."""
    task = [*bucket, "one", "two"]
    return tasks.repartition(*task).sortWithinPartitions(*task)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches in order of ``keys``, cut between groups: each table with the bounds of its groups."""
    carried: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting = pa.Table.from_batches([*carried, batch]).combine_chunks()
        bounds = _bounds(waiting, keys)
        last = int(bounds[-2])
        if last:
            yield waiting.slice(0, last), bounds[:-1]
        carried = waiting.slice(last).combine_chunks().to_batches()
    if carried:
        waiting = pa.Table.from_batches(carried).combine_chunks()
        yield waiting, _bounds(waiting, keys)


def _bounds(rows: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for key in keys:
        value = rows.column(key).to_numpy()
        new[1:] |= value[1:] != value[:-1]
    return np.append(np.flatnonzero(new), rows.num_rows)


def near_pairs(bounds: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs inside groups of at most ``most`` rows, a distance in the group at a time."""
    size = np.diff(bounds)
    end = np.repeat(np.where(size <= most, bounds[1:], 0), size)
    at = np.arange(bounds[-1])
    for step in range(1, int(size[size <= most].max(initial=1))):
        at = at[at + step < end[at]]
        if not len(at):
            return
        yield at, at + step


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest position that pairs of positions connect each position to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new
