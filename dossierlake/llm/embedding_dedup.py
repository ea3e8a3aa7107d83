"""Near duplicates among embeddings: random-hyperplane signs in several tables, exact cosines, connected components.

Vectors on the same side of all hyperplanes of a table share a bucket. Only bucket members are compared, by their cosine in
double precision. A pair is handled in the first table in which it meets, so counting needs no list of pairs: tasks return
how many vectors each member was linked to, and links that connect what is connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.buckets import dealt, local_roots, meetings, near_pairs, whole_groups
from dossierlake.llm.common import stored, table
from dossierlake.llm.components import connected_components

LEAST, RECALL, SEED = 0.9, 0.99, 7
#: Rows of a bucket in a slot, and the group size from which whole matrices of cosines are computed.
SLOT, SMALL = 1024, 48


def shape(n: int, least: float = LEAST, recall: float = RECALL) -> tuple[int, int]:
    """Hyperplanes in a table and number of tables for n vectors.

    Hyperplanes grow with half the logarithm of n, so that neither buckets nor tables grow with n alone. A pair at the
    threshold meets in at least one table with the probability ``recall``; closer pairs do so more often.
    """
    planes = min(24, max(6, round(math.log2(max(n, 2)) / 2) + 4))
    meets = (1 - math.acos(least) / math.pi) ** planes
    return planes, math.ceil(math.log(1 - recall) / math.log(1 - meets))


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: not null, without null or non-finite components, and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, each scaled by its largest component so that squares neither overflow nor vanish."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)
    return values / np.abs(values).max(axis=1, keepdims=True)


def _keyed(classes: DataFrame, planes: int, tables: int, seed: int) -> DataFrame:
    """``cid``, ``dim`` and ``keys``: the side of each table's hyperplanes, as one number a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(lengths).tolist():
                rows = pa.array(np.flatnonzero(lengths == dim))
                if dim not in normals:
                    normals[dim] = np.random.default_rng([seed, dim]).standard_normal((dim, planes * tables))
                sides = _matrix(batch.column("vector").take(rows)) @ normals[dim] > 0
                keys = sides.reshape(len(rows), tables, planes) @ (1 << np.arange(planes))
                lists = pa.ListArray.from_arrays(np.arange(0, len(rows) * tables + 1, tables, dtype=np.int32), pa.array(keys.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("cid").take(rows), pa.array([dim] * len(rows), pa.int32()), lists], ["cid", "dim", "keys"])

    return classes.select("cid", "vector").mapInArrow(run, "cid long, dim int, keys array<int>")


def _compared(tasks: DataFrame, tables: int, least: float) -> DataFrame:
    """``cid``, ``links`` and ``near``: vectors linked to each member in a task, and a member that it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["dim", "t", "key", "one", "two"]):
            cid, copies, t = (rows.column(c).to_numpy() for c in ("cid", "copies", "t"))
            slot, crossing = rows.column("slot").to_numpy(), rows.column("one").to_numpy() != rows.column("two").to_numpy()
            keys = rows.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, tables)
            dims = rows.column("dim").to_numpy()
            vectors = rows.column("vector").combine_chunks()
            found: list[tuple[np.ndarray, np.ndarray]] = []

            def verified(values: np.ndarray, norms: np.ndarray, a: np.ndarray, b: np.ndarray, base: int, cid=cid, t=t, slot=slot, crossing=crossing, keys=keys) -> tuple:
                stay = np.einsum("ij,ij->i", values[a], values[b]) / (norms[a] * norms[b]) >= least
                a, b = a[stay] + base, b[stay] + base
                stay = (cid[a] != cid[b]) & (~crossing[a] | (slot[a] != slot[b]))
                a, b = a[stay], b[stay]
                stay = np.argmax(keys[a] == keys[b], axis=1) == t[a]
                return a[stay], b[stay]

            cut = np.unique(np.concatenate(([0], np.flatnonzero(dims[1:] != dims[:-1]) + 1, [len(dims)])))
            for begin, end in zip(cut.tolist(), cut[1:].tolist(), strict=False):
                values = _matrix(vectors.slice(begin, end - begin))
                norms = np.sqrt(np.einsum("ij,ij->i", values, values))
                inner = bounds[(bounds >= begin) & (bounds <= end)] - begin
                for a, b in near_pairs(inner, SMALL):
                    found.append(verified(values, norms, a, b, begin))
                for group in np.flatnonzero(np.diff(inner) > SMALL).tolist():
                    low, high = inner[group], inner[group + 1]
                    unit = values[low:high] / norms[low:high, None]
                    for top in range(0, high - low, SLOT):
                        a, b = np.nonzero(unit[top : top + SLOT] @ unit.T >= least - 1e-9)
                        a += top
                        later = a < b
                        found.append(verified(values, norms, a[later] + low, b[later] + low, begin))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 2
            if len(a):
                n = len(cid)
                linked = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
                at = np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(linked[at].astype(np.int64)), pa.array(cid[local_roots(n, a, b)[at]])], ["cid", "links", "near"])

    return tasks.mapInArrow(run, "cid long, links long, near long")


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, recall: float = RECALL, seed: int = SEED, slot: int = SLOT
) -> DataFrame:
    """One row per row of ``vectors``: ``id``, ``n_links``, ``component_id`` and ``kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. Equal vectors are compared once and count as often as they come. ``n_links`` counts other rows
    linked directly, ``component_id`` is the smallest id reachable. Rows that repeat an id are rows of their own. All links
    returned have a cosine of ``least`` or more; a pair just at ``least`` is found with probability ``recall``.
    """
    rows = vectors.select(vectors[f"`{id_col}`"].alias("id"), vectors[f"`{vector_col}`"].alias("vector"))
    counted = rows.filter(usable(F.col("vector"))).groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = stored(counted.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    planes, tables = shape(classes.count(), least, recall)
    keyed = stored(_keyed(classes, planes, tables, seed), "sides")
    listed = keyed.select("cid", "dim", F.posexplode("keys").alias("t", "key"))
    bucket = ["dim", "t", "key"]
    met = stored(meetings(listed, bucket, "cid", slot).select("cid", *bucket, "slot", "one", "two"), "meetings")
    tasks = met.join(classes.select("cid", "vector", "copies").join(keyed.select("cid", "keys"), "cid"), "cid")
    order = [*bucket, "one", "two"]
    found = stored(_compared(dealt(tasks, bucket).select(*order, "cid", "slot", "copies", "keys", "vector"), tables, least), "found")
    roots = connected_components(found.select(F.col("cid").alias("a"), F.col("near").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = stored(
        classes.join(links, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        .select("vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "cid").alias("root"), "copies"),
        "rooted",
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("copies").alias("members")).filter("members > 1")
    named = stored(rooted.join(smallest, "root").select(F.col("vector"), "links", F.col("component_id").alias("low")), "named")
    joined = rows.join(named, "vector", "left")
    component = F.coalesce("low", "id")
    return joined.select("id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
