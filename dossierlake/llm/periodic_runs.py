"""Periodic runs of words by seeds on diagonals.

A run with period q has at least ``max(6 - q, 3 * q)`` words that equal the word q further on, so it holds a seed: a k-gram of
that guaranteed overlap that occurs again q words later. Lags are taken in octaves, each with the k of its smallest lag. Such
a k-gram is longer than the period, so inside a run it recurs at multiples of the period only, and the next occurrence of a
k-gram is the only one to look at: a position gives one pair per octave, not one per earlier occurrence. Pairs are extended
along their diagonal, and a table of the furthest place covered at each lag drops pairs inside a stretch that is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.common import table, with_text
from dossierlake.llm.wordstream import PLAIN_GAPS, classes, named, streams

#: A run has at least this many words and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])


def seeds(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per octave of lags the seeds (position, lag), by lag and position. Grams that do not recur are never made longer."""
    n = len(ids)

    def gram(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
        """Names of the grams made of ``left`` and what ``right`` names ``shift`` words further on; -1 where none recurs."""
        at = np.flatnonzero(left[: n - shift] >= 0) if shift < n else np.zeros(0, np.int64)
        at = at[right[at + shift] >= 0]
        out = np.full(n, -1, np.int64)
        if len(at):
            names, counts = named(left[at] * (int(right.max()) + 1) + right[at + shift])
            again = counts[names] > 1
            out[at[again]] = names[again]
        return out

    short = gram(ids, np.zeros(n, np.int64), 0)  # grams of 2 ** octave words
    words = short
    octave = 0
    while (short >= 0).any() and LEAST_PERIODS << octave <= n:
        long = gram(short, short, 1 << octave)
        # The overlap that a run of the smallest lag has: 3 periods, or what is left of the least length.
        if octave == 0:
            long4 = gram(long, long, 2)
            name = gram(long4, words, 4)
        else:
            name = gram(long, short, 2 << octave)
        at = np.flatnonzero(name >= 0)
        order = at[np.argsort(name[at], kind="stable")]
        lag = np.diff(order)
        near = (name[order[1:]] == name[order[:-1]]) & (lag >= 1 << octave) & (lag < 2 << octave)
        where, lag = order[:-1][near], lag[near]
        by = np.lexsort((where, lag))
        yield where[by], lag[by]
        short = long
        octave += 1


def _matching(ids: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on, going by ``step``, equal the word ``lag`` further on."""
    found, width = 0, 32
    left = at + 1 if step < 0 else len(ids) - lag - at
    while found < left:
        width = min(2 * width, left - found)
        here = np.arange(at + step * found, at + step * (found + width), step)
        differ = np.flatnonzero(ids[here] != ids[here + lag])
        if len(differ):
            return found + int(differ[0])
        found += width
    return found


def runs(ids: np.ndarray) -> np.ndarray:
    """All runs of a sequence of numbers as rows (start, length, period), by start and period."""
    found = []
    for where, lags in seeds(ids):
        covered: dict[int, int] = {}
        for at, lag in zip(where.tolist(), lags.tolist(), strict=True):
            if at < covered.get(lag, 0):
                continue
            start = at - _matching(ids, at - 1, lag, -1)
            covered[lag] = at + _matching(ids, at, lag, 1)
            length = covered[lag] - start + lag
            if length >= max(LEAST_WORDS, LEAST_PERIODS * lag):
                found.append((start, length, lag))
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def tiled(row: np.ndarray, rows: int, tile: np.ndarray) -> np.ndarray:
    """For each word the word that stands in its place, where texts with a number ``tile`` >= 0 divisible by 10 repeat a part.

    With g = tile // 10 and n words, word i >= a becomes word a + (i - a) % p, for a = g % n and p = 1 + (n - a) // (3 + g % 8).
    """
    n = np.bincount(row, minlength=rows)
    begin = np.cumsum(n) - n
    g = tile // 10
    a = np.where(n > 0, g % np.maximum(n, 1), 0)
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(len(row)) - begin[row]
    moved = (tile >= 0)[row] & (tile % 10 == 0)[row] & (i >= a[row])
    return np.where(moved, begin[row] + a[row] + (i - a[row]) % p[row], np.arange(len(row)))


def _lists(values: pa.Array, row: np.ndarray, rows: int) -> pa.Array:
    """``values`` as one list per row; ``row`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(rows + 1)), pa.int32()), values)


def periodic_runs(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, tile: Column | None = None) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all), ``runs`` and ``collapsed`` of each row.

    ``runs`` lists start (word number), length and period of every run, by start and period. ``collapsed`` are the words that
    no run holds after its first period, joined by one space. Null and empty texts have no runs and an empty ``collapsed``.
    Rows may repeat; each is judged alone, in the task that reads it, in time n log n of its words. ``tile`` as in
    :func:`tiled`; null leaves a text as it is.
    """
    rows, text = with_text(docs.withColumn("_tile", F.lit(None).cast("long") if tile is None else tile), text_col, [*(docs.columns if keep is None else keep), "_tile"])
    kept = T.StructType([f for f in rows.schema["row"].dataType.fields if f.name != "_tile"])
    schema = T.StructType([T.StructField("row", kept), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    separators = classes(PLAIN_GAPS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, stream in streams(batches, text, separators):
            whole = piece.column("row")
            tiles = pc.fill_null(whole.field("_tile"), -1).to_numpy(zero_copy_only=False)
            place = tiled(stream.row, stream.rows, tiles)
            words, distinct = stream.coded()
            # Words of different texts get different numbers, so nothing matches across texts.
            ids = named(stream.row * max(1, len(distinct)) + words[place])[0] if len(words) else words
            found = runs(ids)
            begin = np.searchsorted(stream.row, np.arange(stream.rows))
            owner = stream.row[found[:, 0]] if len(found) else np.zeros(0, np.int64)
            edges = np.zeros(len(ids) + 1, np.int64)
            np.add.at(edges, found[:, 0] + found[:, 2], 1)
            np.add.at(edges, found[:, 0] + found[:, 1], -1)
            stay = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
            texts = pc.binary_join(_lists(stream.words.cast(pa.binary()).take(pa.array(place[stay])), stream.row[stay], stream.rows), b" ")
            starts = found[:, 0] - begin[owner]
            listed = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in (starts, found[:, 1], found[:, 2])], ["start", "length", "period"])
            row = pa.StructArray.from_arrays([whole.field(f.name) for f in kept.fields], [f.name for f in kept.fields]) if kept.fields else whole
            yield pa.RecordBatch.from_arrays([row, _lists(listed, owner, stream.rows), texts.view(pa.string())], ["row", "runs", "collapsed"])

    return rows.mapInArrow(run, schema)


def best_run(runs_: Column) -> Column:
    """The run with the greatest length / period, of equal ones the smallest start, then period; null without runs.

    Quotients of equal value are equal doubles, and different ones differ up to some 10**7 words a text.
    """
    ranked = F.transform(runs_, lambda r: F.struct((r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"), r["length"].alias("length")))
    return F.array_max(ranked)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    number = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    lines = F.array_join(F.transform(listed, lambda line: F.concat(line, F.lit("\n"))), "")
    done = periodic_runs(docs, keep=["doc_id"], tile=number).withColumn("best", best_run(F.col("runs")))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
