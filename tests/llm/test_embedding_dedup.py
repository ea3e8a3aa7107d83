"""Embeddings against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm import embedding_dedup as e

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType())])


def vectors():
    draw = np.random.default_rng(3)
    rows = []
    for c in draw.standard_normal((30, 16)):
        for _ in range(draw.integers(1, 12)):
            rows.append((c + draw.standard_normal(16) * 0.12).astype(np.float32).tolist())
    dense = draw.standard_normal(16)
    rows += [(dense + draw.standard_normal(16) * 0.1).astype(np.float32).tolist() for _ in range(150)]
    rows += [rows[0]] * 40 + [[x * 2 for x in rows[1]]]
    rows += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [3e38] * 16, [1e-30] * 16]
    return [(i * 2 + 1, v, 0) for i, v in enumerate(rows)]


def brute(rows):
    def unit(v):
        if not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        a = np.array(v, float)
        a /= np.abs(a).max()
        return a / np.linalg.norm(a)

    units = [unit(v) for _, v, _ in rows]
    near = [[j for j, b in enumerate(units) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9] for i, a in enumerate(units)]
    root = list(range(len(rows)))
    for _ in range(len(rows)):
        new = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
        if new == root:
            break
        root = new
    return near, root


@pytest.mark.parametrize("slot", [20, 1024])
def test_against_all_pairs(spark, slot):
    rows = vectors()
    near, root = brute(rows)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("vector", F.lit("clash")).withColumn("links", F.lit(1)).repartition(3)
    found = {r["id"]: r for r in e.near_vectors(frame, recall=0.99999, slot=slot).collect()}
    assert len(found) == len(rows)
    for i, (vec, _, _) in enumerate(rows):
        r = found[vec]
        assert r["n_links"] == len(near[i]), rows[i]
        assert r["component_id"] == rows[root[i]][0] and r["kept"] == (root[i] == i)


def test_recall_at_production_settings(spark):
    """Links found against all links, with the settings of the query."""
    rows = vectors()
    near, _ = brute(rows)
    found = e.near_vectors(spark.createDataFrame(rows, SCHEMA)).agg(F.sum("n_links")).first()[0]
    total = sum(map(len, near))
    assert 0.95 * total <= found <= total


def test_repeated_ids_and_empty(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (None, [1.0, 0.1], 0)], SCHEMA)
    got = sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(frame).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (None, 2, 1, False)], key=str)
    assert e.near_vectors(frame.limit(0)).count() == 0


def test_shape_meets_recall():
    for n in (0, 1, 100, 10**6, 10**12):
        planes, tables = e.shape(n)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** planes) ** tables >= 0.99
