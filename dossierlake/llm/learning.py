"""Small models fitted on bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows of a class that a model is fitted on.
ROWS_EACH = 8000


def remainder(id_: Column, parts: int) -> Column:
    """crc32 of an id as text, modulo ``parts``; 0 for null."""
    return F.coalesce(F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(parts)), F.lit(0)).cast("int")


def sampled(labels: DataFrame, label: str, allowed: Column, rows_each: int = ROWS_EACH) -> DataFrame:
    """``doc_id``, ``label`` (0 or 1) and ``weight`` of at most ``rows_each`` labelled rows of a class, chosen by hash.

    Rows with a null label or id are left out; of repeated ids the largest label counts. Weights restore the shares that the
    classes have among all allowed rows. The result has at most 2 * rows_each rows.
    """
    known = labels.filter(allowed).filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    each = []
    for value in (0, 1):
        # A coarse choice by hash leaves about twice the bound to sort, however many rows are labelled.
        share = min(1.0, (2 * rows_each + 100) / max(1, sizes.get(value, 0)))
        near = known.filter((F.col("label") == value) & (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1_000_000)) < share * 1_000_000))
        chosen = near.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows_each)
        each.append(chosen.withColumn("weight", F.lit(max(1.0, sizes.get(value, 0) / rows_each))))
    return each[0].unionByName(each[1])


def with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with the text of their document: one row per id, however often ``docs`` repeats it; the text of smallest hash."""
    found = docs.select("doc_id", "text").join(F.broadcast(rows.select("doc_id")), "doc_id")
    # A null text is a text too: it stands in a struct, which min_by does not skip.
    one = found.groupBy("doc_id").agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return one.join(F.broadcast(rows), "doc_id").select("doc_id", "row.text", *[c for c in rows.columns if c != "doc_id"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Coefficients of a logistic regression, the constant last, by damped Newton steps."""
    full = np.column_stack([x, np.ones(len(x))])
    penalty = np.full(full.shape[1], ridge)
    penalty[-1] = 1e-6
    beta = np.zeros(full.shape[1])

    def loss(b: np.ndarray) -> float:
        z = full @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + penalty @ b**2 / 2)

    now = loss(beta)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ beta, -40, 40)))
        gradient = full.T @ (weight * (p - y)) + penalty * beta
        hessian = (full * (weight * p * (1 - p))[:, None]).T @ full + np.diag(penalty)
        step, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-4 and loss(beta - size * step) > now:
            size /= 2
        if size <= 1e-4 or now - loss(beta - size * step) < 1e-10 * max(1.0, now):
            break
        beta = beta - size * step
        now = loss(beta)
    return beta


def sigmoid_of(features: list[str], beta: np.ndarray) -> Column:
    """The probability that a logistic regression gives to a row, always between 0 and 1."""
    z = F.lit(float(beta[-1]))
    for name, b in zip(features, beta.tolist(), strict=False):
        z = z + F.col(name) * F.lit(b)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))
