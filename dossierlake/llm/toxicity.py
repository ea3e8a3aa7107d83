"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reported speech, end of a clause). Small transducers follow one
concern each: an insult or threat gives its weight, a target nearby raises it, a negation before it or reported speech around
it lowers it. Their composition, one automaton over the product of their states, scores clauses; a logistic regression on
what the clauses of a document sum up to gives its score.

The lexicon is a base list and what labelled documents teach: words and word beginnings that toxic documents have and others
lack.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.common import pieces, stored, table, with_text
from dossierlake.llm.learning import ROWS_EACH, logistic, remainder, sampled, sigmoid_of, with_texts

#: The base word lists.
INSULTS = "idiot idiots moron morons stupid loser losers pathetic worthless scum trash clown disgusting imbecile filth vermin".split()
THREATS = "kill hurt destroy beat burn stab shoot murder strangle punish".split()
TARGETS = "you your yours yourself u he him she her they them these those this that people everyone".split()
NEGATIONS = "not no never neither nor isn aren wasn weren don doesn didn without hardly".split()
REPORTS = "said says called calls wrote writes quoted reportedly allegedly claimed claims".split()
OTHER, END, INSULT, THREAT, TARGET, NEGATION, REPORT = range(7)
#: Weight of base words, lowest log-odds and support of learned ones, the largest weight, and how many are kept at most.
BASE_WEIGHT, LOG_ODDS, SUPPORT, SHARE, TOP_WEIGHT, ENTRIES = 4.0, 4.0, 4, 0.01, 6.0, 2000
PREFIXES = (4, 5, 6, 7)
HELD_OUT, PARTS, THRESHOLD = 1, 3, 0.7
FEATURES = ["total", "highest", "clauses", "dense"]
#: Words that a task remembers the symbols of.
CACHED_WORDS = 250_000
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """States from ``start``; ``step`` gives the next state and the factor or weight put out for a symbol."""

    start: int
    step: Callable[[int, int], tuple[int, float]]


def _negation(state: int, symbol: int) -> tuple[int, float]:
    """A negation holds for three words of its clause."""
    if symbol == END:
        return 0, 1.0
    if symbol == NEGATION:
        return 3, 1.0
    return max(0, state - 1), (0.3 if state and symbol in (INSULT, THREAT) else 1.0)


def _report(state: int, symbol: int) -> tuple[int, float]:
    """Reported speech holds to the end of its clause."""
    if symbol == END:
        return 0, 1.0
    return (1 if symbol == REPORT else state), (0.6 if state and symbol in (INSULT, THREAT) else 1.0)


def _target(state: int, symbol: int) -> tuple[int, float]:
    """Somebody named up to four words before raises an insult; a threat counts only with somebody named."""
    if symbol == END:
        return 0, 1.0
    if symbol == TARGET:
        return 4, 1.0
    factor = {INSULT: 1.25 if state else 1.0, THREAT: 1.0 if state else 0.2}.get(symbol, 1.0)
    return max(0, state - 1), factor


def _attack(state: int, symbol: int) -> tuple[int, float]:
    """Puts out one for an insult or threat, more for the second and further ones of a clause."""
    if symbol == END:
        return 0, 0.0
    if symbol in (INSULT, THREAT):
        return 1, 1.2 if state else 1.0
    return state, 0.0


GRAMMAR = [Transducer(0, f) for f in (_attack, _target, _negation, _report)]


def composed(parts: list[Transducer], symbols: int = 7) -> tuple[list[list[int]], list[list[float]]]:
    """The composition as tables [state][symbol] of next states and outputs, over the states that can be reached."""
    start = tuple(p.start for p in parts)
    number, order = {start: 0}, [start]
    moves: list[list[int]] = []
    outputs: list[list[float]] = []
    for state in order:
        row, out = [], []
        for symbol in range(symbols):
            steps = [p.step(s, symbol) for p, s in zip(parts, state, strict=True)]
            following = tuple(s for s, _ in steps)
            if following not in number:
                number[following] = len(order)
                order.append(following)
            row.append(number[following])
            out.append(math.prod(w for _, w in steps))
        moves.append(row)
        outputs.append(out)
    return moves, outputs


@dataclass
class Lexicon:
    """Weights of whole words and of word beginnings that count as insults."""

    words: dict[str, float] = field(default_factory=lambda: dict.fromkeys(INSULTS, BASE_WEIGHT))
    beginnings: dict[str, float] = field(default_factory=dict)

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.beginnings.get(word[:n], 0.0) for n in PREFIXES if len(word) >= n)])


class _Symbols(dict):
    """(symbol, weight) of words; None for words without a role."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon
        self.roles: dict[str, tuple[int, float]] = {x: (END, 0.0) for x in ".!?;\n"}
        for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)):
            self.roles |= dict.fromkeys(words, (symbol, BASE_WEIGHT))

    def __missing__(self, word: str) -> tuple[int, float] | None:
        found = self.roles.get(word)
        if found is None and (weight := self.lexicon.weight(word)) > 0:
            found = (INSULT, weight)
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


class Scorer:
    """Features of texts by the composed grammar."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.symbols = _Symbols(lexicon)
        self.moves, self.outputs = composed(GRAMMAR)

    def clauses(self, text: str) -> tuple[list[float], int]:
        """Scores of the clauses that hold a match, and the number of tokens."""
        tokens = _TOKEN.findall(text.lower())
        roles = list(map(self.symbols.__getitem__, tokens))
        if not any(r is not None and r[0] in (INSULT, THREAT) for r in set(roles)):
            return [], len(tokens)
        moves, outputs = self.moves, self.outputs
        state, score, gap, scores = 0, 0.0, 0, []
        for role in roles:
            if role is None:
                gap += 1
                continue
            for _ in range(min(gap, 4)):  # more words without a role change no state further
                state = moves[state][OTHER]
            gap = 0
            symbol, weight = role
            score += outputs[state][symbol] * weight
            state = moves[state][symbol]
            if symbol == END:
                if score:
                    scores.append(score)
                score = 0.0
        return (scores + [score] if score else scores), len(tokens)

    def features(self, text: str) -> tuple[float, float, float, float]:
        scores, tokens = self.clauses(text)
        if not scores:
            return 0.0, 0.0, 0.0, 0.0
        return math.log1p(sum(scores)), min(max(scores), 20.0), math.log1p(len(scores)), min(1.0, len(scores) * 20 / max(tokens, 20))


def measured(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (the columns ``keep``, or all) and the features of each row."""
    rows, text = with_text(docs, text_col, keep)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # at most ENTRIES words beside the base list
    schema = T.StructType([rows.schema["row"], *[T.StructField(name, T.DoubleType()) for name in FEATURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for piece, texts in pieces(batches, text):
            values = np.array([scorer.features(t) for t in texts], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([piece.column("row"), *[pa.array(values[:, i]) for i in range(len(FEATURES))]], ["row", *FEATURES])

    return rows.mapInArrow(run, schema)


def _beginnings(n: int) -> Column:
    """The first n letters of all words that have as many."""
    return F.transform(F.filter("words", lambda w: F.length(w) >= n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))


def learned(sample: DataFrame) -> Lexicon:
    """The base list with what the labelled sample (``doc_id``, ``text``, ``label``) teaches.

    Toxic documents that agree in their smallest word hash are near copies and count once, or one text copied often would
    teach its rarest words.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0)))
    listed = sample.select("doc_id", "label", words.alias("words"))
    sketch = F.coalesce(F.array_min(F.transform(F.filter("words", lambda w: F.length(w) >= 6), lambda w: F.xxhash64(w))), F.xxhash64("doc_id"))
    single = listed.withColumn("sketch", F.when(F.col("label") == 1, sketch).otherwise(F.xxhash64("doc_id")))
    chosen = single.groupBy("label", "sketch").agg(F.min_by("words", "doc_id").alias("words"))
    chosen = stored(chosen.select("label", "words"), "lexicon-sample")
    sizes = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    lexicon = Lexicon()
    if not toxic or not clean:
        return lexicon
    starts = F.flatten(F.array(*[_beginnings(n) for n in PREFIXES]))
    entries = F.array_distinct(F.concat(F.transform("words", lambda w: F.concat(F.lit("="), w)), starts))
    counted = chosen.select("label", F.explode(entries).alias("entry")).groupBy("entry").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(clean + 1.0))
    strong = counted.filter(F.col("pos") >= max(SUPPORT, math.ceil(SHARE * toxic))).withColumn("odds", odds).filter(F.col("odds") >= LOG_ODDS)
    rows = strong.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), "entry").limit(ENTRIES).collect()
    for row in sorted(rows, key=lambda r: (r["entry"][0] == "=", len(r["entry"]), r["entry"])):
        entry, weight = row["entry"], min(TOP_WEIGHT, row["odds"])
        # A beginning stands for the longer ones and for words, unless one of them is as frequent and so more exact.
        longer = (o for o in rows if o["entry"][1:].startswith(entry[1:]) and (len(o["entry"]), o["entry"][0] == "=") > (len(entry), entry[0] == "="))
        if any(o["pos"] >= 0.95 * row["pos"] for o in longer):
            continue
        if lexicon.weight(entry[1:]) < weight:
            (lexicon.words if entry[0] == "=" else lexicon.beginnings)[entry[1:]] = weight
    return lexicon


@dataclass
class Model:
    lexicon: Lexicon
    beta: np.ndarray


def train(docs: DataFrame, labels: DataFrame, rows_each: int = ROWS_EACH) -> Model:
    """Lexicon and regression from at most ``rows_each`` labelled rows of a class, none of them held out.

    Without rows of both classes the base list and fixed coefficients serve.
    """
    rows = sampled(labels, "toxic", remainder(F.col("doc_id"), PARTS) != HELD_OUT, rows_each)
    sample = stored(with_texts(docs, rows), "toxicity-sample")
    lexicon = learned(sample)
    seen = measured(sample, lexicon, keep=["label", "weight"]).select("row.*", *FEATURES).toPandas()
    if seen["label"].nunique() < 2:
        return Model(lexicon, np.array([1.0, 0.2, 0.5, 1.0, -3.0]))
    return Model(lexicon, logistic(seen[FEATURES].to_numpy(), seen["label"].to_numpy(float), seen["weight"].to_numpy()))


def scored(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, the features and ``score`` (0 to 1) of each row of ``docs``.

    Null and empty texts, and texts without a match, get the score of no match. Whole texts are read. Rows may repeat.
    """
    return measured(docs, model.lexicon, text_col, keep).withColumn("score", sigmoid_of(FEATURES, model.beta))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, as they are."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored(docs, model).filter(F.col("score") < THRESHOLD).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = scored(docs, train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return done.select(
        F.col("row.doc_id").alias("doc_id"), (remainder(F.col("row.doc_id"), PARTS) == HELD_OUT).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), *FEATURES,
    )
