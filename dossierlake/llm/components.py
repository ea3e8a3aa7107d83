"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import stored

MOST_ROUNDS = 100


def _nearest(pairs: DataFrame) -> DataFrame:
    """The smallest ``b`` of each ``a``, as a table, so that the join with it is planned afresh and may be split by size."""
    return stored(pairs.groupBy("a").agg(F.min("b").alias("low")), "nearest")


def _round(links: DataFrame) -> DataFrame:
    """One round over links with ``a`` > ``b``: every node's larger neighbours, then its smaller ones, move to the smallest."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    outward = both.filter("b > a").join(_nearest(both), "a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()
    outward = stored(outward, "outward")
    near = _nearest(outward)
    moved = outward.join(near, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return stored(moved.unionByName(near.select("a", F.col("low").alias("b"))).distinct(), "inward")


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for all nodes of links ``a``, ``b`` other than the roots.

    Links may come in any order and repeatedly; links of a node to itself are ignored. Each round is written to the shared
    scratch space. Rounds go on until the links stop changing; they number about the logarithm of the longest chain.
    """
    now = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    for _ in range(MOST_ROUNDS):
        if not state[0]:
            break
        now = _round(now)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
