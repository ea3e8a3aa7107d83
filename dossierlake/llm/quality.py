"""Document quality by Bradley-Terry pairwise ranking.

All pairs of a better and a worse document teach a linear score: the probability that one is preferred is the logistic
function of the difference of their features. Scores are then cut at the quantile that the share of bad documents gives.

Every labelled row counts. The sums over all pairs that a Newton step needs follow from sums of the rows of each class and
narrow bin of score, so a step is one pass over the measured rows, and the cut is found exactly by counting in bins.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.common import pieces, stored, table, with_text
from dossierlake.llm.learning import remainder, sigmoid_of

HELD_OUT, PARTS, THRESHOLD = 0, 5, 0.3
#: How many comparisons the mean over all pairs counts as against the ridge, and how many of a document's standard deviations
#: the score's slope spreads over.
PAIRS, RIDGE, SLOPE = 60_000, 20.0, 4.0
#: Bins of a unit of score, where scores are less than WIDE units from zero (beyond it they widen), Newton steps at most, and
#: bins that a pass for the quantile counts in.
FINE, WIDE, ROUNDS, COUNTED = 16, 16.0, 40, 4096
SYMBOLS = "!#$%&*|<>{}[]=_~^@\\/+"
FEATURES = [
    "words", "distinct", "repeats", "capitals", "symbols", "symbol_words", "digits", "bars", "length", "lines", "worst_repeats", "worst_capitals", "worst_symbols", "worst_bars", "stops",
]


def _line(line: str) -> tuple[float, float, float, float, int]:
    """Repeated, upper-case and symbol-bearing words and bars of one line, and its words."""
    words = line.split()
    n = len(words)
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0
    repeated = sum(map(operator.eq, words, words[1:]))
    upper = sum(1 for w in words if len(w) > 1 and w.isupper())
    bars = line.count("|")
    ended = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:\"')|")
    return repeated, upper, ended, bars, n


def features(text: str) -> list[float]:
    """Shares, counts and the worst line of a text; all zero for a text without words."""
    per_line = [_line(line) for line in text.split("\n")]
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    repeated, upper, ended, bars, _ = (sum(x) for x in zip(*per_line, strict=True))
    # Short texts and lines are judged as if they were longer, or chance would decide.
    worst = [max(line[i] / max(line[4], 8) for line in per_line) for i in range(4)]
    symbols = sum(map(text.count, SYMBOLS))
    digits = sum(map(text.count, "0123456789"))
    return [
        math.log1p(n), len(set(words)) / n**0.9, math.sqrt(repeated / max(n, 12)), math.sqrt(upper / max(n, 12)), math.sqrt(symbols / len(text)), math.sqrt(ended / n),
        math.sqrt(digits / len(text)), math.sqrt(bars / n), min(len(text) / n, 30.0), math.log1p(len(per_line)), *map(math.sqrt, worst), math.sqrt(text.count(".") / n),
    ]


def measured(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, or all) and the features of each row."""
    rows, text = with_text(docs, text_col, keep)
    schema = T.StructType([rows.schema["row"], *[T.StructField(name, T.DoubleType()) for name in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, text):
            values = np.array([features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([piece.column("row"), *[pa.array(values[:, i]) for i in range(len(FEATURES))]], ["row", *FEATURES])

    return rows.mapInArrow(run, schema)


@dataclass
class Model:
    """``beta`` holds a coefficient for each feature and the constant that puts the cut at THRESHOLD."""

    beta: np.ndarray


def _bins(score: np.ndarray) -> np.ndarray:
    """The bin of each score, of width 1 / FINE up to WIDE units from zero and in proportion to the score beyond."""
    size = np.abs(score)
    far = np.where(size > WIDE, WIDE * (1 + np.log(np.maximum(size, WIDE) / WIDE)), size)
    return np.floor(np.copysign(far, score) * FINE).astype(np.int64)


def binned(x: np.ndarray, label: np.ndarray, weight: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels and bins that have rows, and the sums of each: weight, features, and products of two features."""
    bin_ = _bins(x @ beta)
    keys, group = np.unique(np.column_stack([label, bin_]), axis=0, return_inverse=True)
    order = np.argsort(group.reshape(-1), kind="stable")
    starts = np.searchsorted(group.reshape(-1)[order], np.arange(len(keys)))
    one, two = np.triu_indices(x.shape[1])
    x, weight = x[order], weight[order][:, None]
    sums = [np.add.reduceat(part, starts, axis=0) for part in (weight, x * weight, x[:, one] * x[:, two] * weight)] if len(keys) else [np.zeros((0, 1 + x.shape[1] + len(one)))]
    return keys[:, 0], keys[:, 1], np.hstack(sums)


def _pairwise(label: np.ndarray, sums: np.ndarray, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean loss of all pairs of a good and a bad row, its gradient and its Hessian; the rows of a bin count with its mean score."""
    d = len(beta)
    one, two = np.triu_indices(d)

    def parts(of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        squares = np.zeros((len(of), d, d))
        squares[:, one, two] = squares[:, two, one] = of[:, 1 + d :]
        return of[:, 0], of[:, 1 : 1 + d], squares

    (n, x, xx), (m, y, yy) = parts(sums[label == 1]), parts(sums[label == 0])
    gap = (x @ beta / n)[:, None] - (y @ beta / m)[None, :]
    wrong = 1 / (1 + np.exp(np.clip(gap, -500, 500)))
    curve = wrong * (1 - wrong)
    pairs = n.sum() * m.sum()
    loss = float(n @ np.logaddexp(0, -gap) @ m) / pairs
    gradient = (n @ wrong @ y - (wrong @ m) @ x) / pairs
    cross = x.T @ curve @ y
    hessian = (np.tensordot(curve @ m, xx, 1) + np.tensordot(n @ curve, yy, 1) - cross - cross.T) / pairs
    return loss, gradient, hessian


def strengths(sums_at: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], d: int, pairs: int = PAIRS) -> np.ndarray:
    """Coefficients of ``d`` standardised features by damped Newton steps; ``sums_at`` gives the binned sums at coefficients."""
    beta = tried = np.zeros(d)
    now, step, size = math.inf, np.zeros(d), 1.0
    for _ in range(ROUNDS):
        label, _, sums = sums_at(tried)
        loss, gradient, hessian = _pairwise(label, sums, tried)
        loss += RIDGE / pairs * float(tried @ tried) / 2
        if loss > now:
            # Bins change with the coefficients, which alone moves the loss a little where the step is done.
            if loss - now < 1e-6 or size < 1e-3:
                break
            size /= 2
        else:
            done = now - loss < 1e-7
            beta, now, size = tried, loss, 1.0
            if done:
                break
            step = np.linalg.solve(hessian + RIDGE / pairs * np.eye(d), gradient + RIDGE / pairs * beta)
        tried = beta - size * step
    return beta


def _one_class(d: int, good: bool) -> Model:
    return Model(np.append(np.zeros(d), math.log(THRESHOLD / (1 - THRESHOLD)) + (1.0 if good else -1.0)))


def _model(strength: np.ndarray, cut: float, spread: float) -> Model:
    slope = SLOPE / max(spread, 1e-9)
    return Model(np.append(strength * slope, math.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut))


def fitted(x: np.ndarray, label: np.ndarray, weight: np.ndarray, pairs: int = PAIRS) -> Model:
    """Bradley-Terry on all pairs of a good and a bad row, which count as ``pairs`` comparisons; the cut is the weighted quantile of the bad share.

    For rows in memory; :func:`train` does the same where they are a table.
    """
    if not (label == 1).any() or not (label == 0).any():
        return _one_class(x.shape[1], (label == 1).any() or not (label == 0).any())
    scale = x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    centre = x.mean(axis=0)
    strength = strengths(lambda beta: binned((x - centre) / scale, label, weight, beta), x.shape[1], pairs) / scale
    raw = x @ strength
    order = np.argsort(raw, kind="stable")
    below = np.cumsum(weight[order])
    share = weight[label == 0].sum() / weight.sum()
    at = min(int(np.searchsorted(below, share * below[-1])), len(order) - 2)
    return _model(strength, (raw[order[at]] + raw[order[at + 1]]) / 2, raw.std())


def _table_sums(rows: DataFrame, centre: np.ndarray, scale: np.ndarray, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`binned` over a table of ``label`` and FEATURES: each task adds up its batches, the results meet by bin."""

    def added(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for labels, bins, sums in parts:
            for key, sum_ in zip(zip(labels.tolist(), bins.tolist(), strict=True), sums, strict=True):
                total[key] = total[key] + sum_ if key in total else sum_
        if total:
            keys, sums = np.array(list(total), np.int64), np.array(list(total.values()))
            offsets = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * sums.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(offsets, pa.array(sums.reshape(-1)))], ["label", "bin", "sums"])

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return batch.column("label").to_numpy(), batch.column("bin").to_numpy(), batch.column("sums").flatten().to_numpy().reshape(batch.num_rows, -1)

    def sums_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = (np.column_stack([batch.column(name).to_numpy() for name in FEATURES]) - centre) / scale
        return binned(x, batch.column("label").to_numpy(), np.ones(len(x)), beta)

    schema = "label long, bin long, sums array<double>"
    found = rows.mapInArrow(lambda batches: added(map(sums_of, batches)), schema)
    # Sums of a bin are added in a fixed order, so that reruns agree.
    dealt = found.repartition("label", "bin").sortWithinPartitions("label", "bin", "sums")
    done = dealt.mapInArrow(lambda batches: added(map(arrays, batches)), schema).orderBy("label", "bin").toArrow()
    return arrays(done.combine_chunks().to_batches()[0])


def _at_rank(raw: DataFrame, low: float, high: float, rank: int) -> float:
    """The value ``raw`` of the given rank, from 0; exact: each pass counts in bins and keeps the one that holds the rank."""
    while low < high:
        width = (high - low) / COUNTED
        # Where bins would be narrower than numbers, each number is one.
        number = F.floor((F.col("raw") - F.lit(low)) / F.lit(width)).cast("double") if low + width > low else F.col("raw")
        inside = raw.filter((F.col("raw") >= low) & (F.col("raw") <= high)).groupBy(number.alias("number")).agg(F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"))
        for r in sorted(inside.collect(), key=lambda r: r["number"]):
            if rank < r["n"]:
                break
            rank -= r["n"]
        low, high = r["low"], r["high"]
    return low


def train_measured(seen: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows that are not held out; ``seen`` has ``row`` (``doc_id`` and ``text_hash``) and FEATURES of all documents.

    Rows with a null label or id are left out; of repeated ids the largest label and the text of smallest hash count. With
    rows of one class only, all documents get that class; without labels, all pass.
    """
    allowed = F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), PARTS) != HELD_OUT)
    known = labels.filter(allowed).groupBy("doc_id").agg(F.max("quality").cast("long").alias("label"))
    one = F.min(F.struct("row.text_hash", *FEATURES)).alias("first")
    each = seen.filter("row.doc_id IS NOT NULL").groupBy(F.col("row.doc_id").alias("doc_id")).agg(one)
    rows = stored(each.join(known, "doc_id").select("label", "first.*").drop("text_hash"), "quality-rows")
    spread = [f(name).alias(f"{f.__name__}-{name}") for f in (F.avg, F.stddev_pop) for name in FEATURES]
    about = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("good"), *spread).first()
    n, good = about["n"], about["good"]
    if good in (0, n):
        return _one_class(len(FEATURES), good or not n)
    centre, scale = (np.array([about[f"{f}-{name}"] for name in FEATURES]) for f in ("avg", "stddev_pop"))
    scale[scale < 1e-9] = 1.0
    strength = strengths(lambda beta: _table_sums(rows, centre, scale, beta), len(FEATURES)) / scale
    score = F.lit(0.0)
    for name, b in zip(FEATURES, strength.tolist(), strict=True):
        score = score + F.col(name) * F.lit(b)
    raw = stored(rows.select(score.alias("raw")), "quality-raw")
    ends = raw.agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.stddev_pop("raw").alias("spread")).first()
    at = min(n - good - 1, n - 2)
    cut = sum(_at_rank(raw, ends["low"], ends["high"], rank) for rank in (at, at + 1)) / 2
    return _model(strength, cut, ends["spread"])


def _measured_once(docs: DataFrame) -> DataFrame:
    """``row`` (``doc_id``, ``text_hash``) and FEATURES of each row of ``docs``, written once."""
    return stored(measured(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), keep=["doc_id", "text_hash"]), "quality-measured")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows of ``docs``, none of them held out; see :func:`train_measured`."""
    return train_measured(_measured_once(docs), labels)


def with_score(seen: DataFrame, model: Model) -> DataFrame:
    """``seen`` with ``score``: 0 to 1, the cut at THRESHOLD."""
    return seen.withColumn("score", sigmoid_of(FEATURES, model.beta))


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, the features and ``score`` (0 to 1, the cut at THRESHOLD) of each row of ``docs``.

    Null and empty texts, and texts without words, have all features 0. Whole texts are read. Rows may repeat.
    """
    return with_score(measured(docs, text_col, keep), model)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are measured once, for training and for scoring.
    seen = _measured_once(table(spark, sf_dir, "documents"))
    done = with_score(seen, train_measured(seen, table(spark, sf_dir, "labels")))
    return done.select(
        F.col("row.doc_id").alias("doc_id"), (remainder(F.col("row.doc_id"), PARTS) == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), *FEATURES,
    )
