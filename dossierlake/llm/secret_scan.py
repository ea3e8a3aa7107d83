"""Secrets by patterns, and by a battery of randomness tests for strings that no pattern knows.

Long unbroken strings outside the patterns' spans are candidates. Their encoding is inferred from the characters they use.
Three tests ask whether they could be random: uniformity of the alphabet (chi-squared), runs about the middle of the alphabet
and serial correlation. A fourth figure asks whether they could be ordinary text: the likelihood ratio of a uniform alphabet
against the character frequencies of the whole corpus, whose spread under ordinary text depends on the length. The candidates
that pass the battery are secrets where the rate of false discoveries among all candidates allows it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.common import pieces, stored, table, with_text

#: The patterns, the least length of what counts in them, and the order of the kinds.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a maximal run of 16 or more is what [0-9a-f]+ gives
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KEYWORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ["assign", "access", "hex", "random"]
#: Candidates have at least so many characters; the level of each test of the battery; the rate of false discoveries.
CANDIDATE_LEAST, LEVEL, FALSE_RATE = 20, 0.001, 0.01
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}")
ENCODINGS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "upperhex": "0123456789ABCDEF",  # after base32, which few of its strings fit: 1 in 1,000 of 24 characters
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64url": "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
    "mixed": "+-/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz",
}
#: Groups of digits and letters of one case, with one separator between any two; groups without any digit are words.
GROUPED = re.compile(r"(?=.*[0-9])(?:(?:[0-9a-z]+[-_])+[0-9a-z]+|(?:[0-9A-Z]+[-_])+[0-9A-Z]+)")
_SETS = {name: frozenset(letters) for name, letters in ENCODINGS.items()}
#: p-values of the fourth figure are counted by tenths of their decimal exponent, down to this one.
BINS = 3000
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.IntegerType())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find, leftmost and non-overlapping for each kind."""
    low = text.lower()
    found = []
    if any(word in low for word in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, string) of the long unbroken strings that overlap no span; padding at their ends is left off.

    Both come in order of their starts, so one walk over both tells: a string is free where no span that starts before its
    end reaches beyond its start.
    """
    out = []
    at = reach = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reach = max(reach, taken[at][2])
            at += 1
        if reach <= start:
            body = m[0].strip("=_-")
            if len(body) >= CANDIDATE_LEAST:
                out.append((start, end, body))
    return out


def letters_of(body: str) -> str:
    """The characters that are tested: without padding, and without separators between groups of one case, as in a UUID.

    In strings of both cases dashes and underscores are letters of base64url.
    """
    plain = body.replace("=", "")
    return plain.replace("-", "").replace("_", "") if GROUPED.fullmatch(plain) else plain


def encoding(body: str) -> str:
    """The narrowest alphabet that holds all characters, separators aside."""
    used = frozenset(letters_of(body))
    return next((name for name, letters in _SETS.items() if used <= letters), "mixed")


def _upper_chi(x: float, free: int) -> float:
    """Upper tail of chi-squared by the cube-root approximation."""
    z = ((x / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(body: str) -> tuple[str, float, float, float]:
    """Encoding and p-values of uniformity, runs and serial correlation, small for strings that are not random."""
    name = encoding(body)
    place = {c: i for i, c in enumerate(ENCODINGS[name])}
    x = np.array([place[c] for c in letters_of(body)], float)
    n, size = len(x), len(place)
    if n < 3:
        return name, 0.0, 0.0, 0.0
    counts = np.bincount(x.astype(int), minlength=size)
    uniform = _upper_chi(float(((counts - n / size) ** 2).sum() * size / n), size - 1)
    high = x >= size / 2
    ups = int(high.sum())
    downs = n - ups
    if ups and downs:
        runs, mean = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * ups * downs / n
        spread = math.sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-12))
        by_runs = math.erfc(abs(runs - mean) / spread / math.sqrt(2))
    else:
        by_runs = 2.0 ** (1 - n)
    centred = x - x.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    return name, uniform, by_runs, math.erfc(abs(serial * n + 1) / math.sqrt(n) / math.sqrt(2))


def ordinary(body: str, name: str, frequency: np.ndarray) -> float:
    """Probability that ordinary text of this length and alphabet looks as uniform as the string.

    The logarithm of the likelihood ratio is a sum over characters. Its mean and variance under the corpus' frequencies are
    known, so its tail follows from the length.
    """
    letters = np.frombuffer(ENCODINGS[name].encode(), np.uint8)
    q = (frequency[letters] + 1) / (frequency[letters].sum() + len(letters))
    gain = -np.log(q * len(letters))
    mean = float(q @ gain)
    variance = float(q @ (gain - mean) ** 2)
    by_byte = np.zeros(256)
    by_byte[letters] = gain
    used = np.frombuffer(letters_of(body).encode(), np.uint8)
    z = (float(by_byte[used].sum()) - len(used) * mean) / math.sqrt(max(len(used) * variance, 1e-12))
    return max(0.5 * math.erfc(z / math.sqrt(2)), 1e-300)


def _found(docs: DataFrame, text_col: str, keep: list[str] | None) -> DataFrame:
    """``row``, ``base`` spans and ``tried`` candidates of each row; some rows carry counts of characters in ``seen``."""
    rows, text = with_text(docs, text_col, keep)
    tried = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("body", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("battery", T.DoubleType())])
    schema = T.StructType([rows.schema["row"], T.StructField("base", T.ArrayType(SPAN)), T.StructField("tried", T.ArrayType(tried)), T.StructField("seen", T.ArrayType(T.LongType()))])
    arrow = {f.name: pa.list_(pa.struct([(g.name, {"integer": pa.int32(), "string": pa.string(), "double": pa.float64()}[g.dataType.typeName()]) for g in f.dataType.elementType])) for f in schema if f.name in ("base", "tried")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in pieces(batches, text):
            seen, base, tried = np.zeros(256, np.int64), [], []
            for t in texts:
                seen += np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
                spans = base_spans(t)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                here = []
                for start, end, body in candidates(t, spans):
                    name, *values = battery(body)
                    here.append({"start": start, "end": end, "body": body, "encoding": name, "battery": min(values)})
                tried.append(here)
            counts = pa.array([seen.tolist()] + [None] * (piece.num_rows - 1), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(base, arrow["base"]), pa.array(tried, arrow["tried"]), counts], ["row", "base", "tried", "seen"])

    return rows.mapInArrow(run, schema)


def _weighed(found: DataFrame, frequency, level: float) -> DataFrame:
    """``found`` with ``bins``: the exponent bin of each candidate, 0 if the battery rejects it."""
    schema = T.StructType([*(found.schema[name] for name in ("row", "base", "tried")), T.StructField("bins", T.ArrayType(T.IntegerType()))])

    def bin_of(candidate: dict) -> int:
        if candidate["battery"] < level:
            return 0
        return min(BINS, math.floor(-10 * math.log10(ordinary(candidate["body"], candidate["encoding"], frequency.value))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [[bin_of(c) for c in tried] for tried in batch.column("tried").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bins, pa.list_(pa.int32()))], [*batch.schema.names, "bins"])

    return found.select("row", "base", "tried").mapInArrow(run, schema)


def discovery_limit(exponents: dict[int, int], false_rate: float = FALSE_RATE) -> int | None:
    """The least exponent bin that may be called, from the number of p-values in each: the step-up rule.

    A bin b stands for p-values of at most 10 ** (-b / 10). Bin 0 holds what the battery rejects; it counts as tested and is
    never called. None if nothing may be called.
    """
    tested, called, best = sum(exponents.values()), 0, None
    for bin_ in sorted(exponents, reverse=True):
        called += exponents[bin_]
        if bin_ > 0 and 10 ** (-bin_ / 10) <= false_rate * called / tested:
            best = bin_
    return best


def secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, level: float = LEVEL, false_rate: float = FALSE_RATE) -> DataFrame:
    """``row`` (the columns ``keep`` of ``docs``, or all) and ``spans``, sorted structs of ``start``, ``kind`` (place in KINDS) and ``end``.

    Positions are code points, ends exclusive. Null and empty texts have no spans. Whole texts are scanned, character
    frequencies and the discovery limit come from all rows. Spans of different kinds may overlap; ``random`` ones overlap none.
    Rows may repeat; each counts.
    """
    spark = docs.sparkSession
    found = stored(_found(docs, text_col, keep), "scanned")
    seen = found.filter("seen is not null").select(F.posexplode("seen").alias("byte", "n")).groupBy("byte").agg(F.sum("n").alias("n")).collect()
    frequency = np.zeros(256)
    for r in seen:
        frequency[r["byte"]] = r["n"]
    weighed = stored(_weighed(found, spark.sparkContext.broadcast(frequency), level), "weighed")  # 256 numbers
    bins = weighed.select(F.explode("bins").alias("bin")).groupBy("bin").agg(F.count("*").alias("n")).collect()  # at most BINS + 1
    limit = discovery_limit({r["bin"]: r["n"] for r in bins}, false_rate)
    called = F.filter(F.arrays_zip("tried", "bins"), lambda x: x["bins"] >= F.lit(BINS + 1 if limit is None else limit))
    added = F.transform(called, lambda x: F.struct(x["tried"]["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["tried"]["end"].alias("end")))
    return weighed.select("row", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return done.select(
        F.col("row.doc_id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
