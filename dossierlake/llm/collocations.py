"""Phrases whose words occur together more than apart, from sorted streams of phrase counts.

Counts of all orders stand in one table, which is read as two streams: by what phrases begin with and by what they end with.
Merge joins walk each stream in lockstep with the parts of the longer phrases, sorted the same way: the stream of beginnings
gives left counts and extensions to the right, the stream of endings right counts and extensions to the left. Nothing is
looked up in a hash table.

Counting takes three passes over the texts. A phrase is as frequent as its parts at most, so the second pass counts only pairs
of frequent words, by a number of 48 bits, and the third only phrases made of frequent pairs, as they are. What is frequent is
told to the tasks by a bit filter of bounded size. Its false positives, and pairs that share a number, are counted in the
third pass like the others and drop out, so counts are exact however full the filter gets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossierlake.llm.common import slices, stored, table, text_of
from dossierlake.llm.wordstream import Stream, classes

#: What separates words and pieces, the longest phrase, the least count of a candidate.
GAPS, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
LONGEST, LEAST = 4, 30
#: A longer candidate with this share (in hundredths) of a phrase's count replaces it; phrases per language.
SHARE, TOP = 80, 2000
NO_LANGUAGE = "und"
#: Bytes of text whose phrases are counted together before they leave a task.
COUNTED_BYTES = 2 << 20
#: Bits of a filter per entry, and at least and at most in all (16 MB).
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 27


#: Numbers of words and pairs have this many bits.
NUMBER = np.uint64((1 << 48) - 1)


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hashes(values: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


class Filter:
    """Bits that tell which numbers are perhaps present; shared with the tasks as bytes."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits
        self.mask = np.uint64(64 * len(bits) - 1)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return numbers & self.mask, (numbers >> np.uint64(21)) & self.mask

    def has(self, numbers: np.ndarray) -> np.ndarray:
        found = np.ones(len(numbers), bool)
        for place in self.places(numbers):
            found &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return found


def share_filter(numbers: DataFrame):
    """A broadcast filter of the column ``number``. Tasks set the bits; the driver gets words of 64 bits, MOST_BITS in all at most."""
    spark = numbers.sparkSession
    size = LEAST_BITS
    entries = numbers.count()
    while size < min(MOST_BITS, BITS_EACH * entries):
        size *= 2
    empty = Filter(np.zeros(size // 64, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.concatenate(empty.places(batch.column("number").to_numpy().view(np.uint64)))
            slot, names = np.unique(place >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(slot), np.uint64)
            np.bitwise_or.at(bits, names, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(bits.view(np.int64))], ["slot", "bits"])

    found = numbers.select("number").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return spark.sparkContext.broadcast(bits.tobytes())


def word_numbers(words: DataFrame) -> DataFrame:
    """``number`` of each row's lang and phrase, a single word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = _mixed(_hashes(batch.column("lang")), _hashes(batch.column("phrase")))
            yield pa.RecordBatch.from_arrays([pa.array((hashes & NUMBER).view(np.int64))], ["number"])

    return words.select("lang", "phrase").mapInArrow(run, "number long")


class Slice:
    """Words of some texts: per word its language and word as one number, with the hash of each number's pair."""

    def __init__(self, texts: pa.Array, langs: pa.Array) -> None:
        stream = Stream(texts, classes(GAPS, BREAKS), lower=True)
        ids, self.words = stream.coded()
        both = langs.dictionary_encode()
        self.langs = both.dictionary
        lang = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)[stream.row]
        code, self.at, counts = np.unique(lang * max(1, len(self.words)) + ids, return_inverse=True, return_counts=True)
        self.counts = counts
        self.lang, self.word = np.divmod(code, max(1, len(self.words)))
        self.segment = stream.segment


    def pairs(self, frequent: Filter) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs of frequent words inside a piece, and the number (in this slice) of each one's pair.

        Pair i is made of ``left[i]`` and ``right[i]``; ``numbers`` are what other tasks call them too.
        """
        size = max(1, len(self.word))
        spelled = _hashes(self.words)[self.word]
        hashes = _mixed(_hashes(self.langs)[self.lang], spelled)
        known = frequent.has(hashes & NUMBER)[self.at]
        places = np.flatnonzero(known[:-1] & known[1:] & (self.segment[:-1] == self.segment[1:])) if len(known) else np.zeros(0, np.int64)
        code, pair, self.pair_counts = np.unique(self.at[places] * size + self.at[places + 1], return_inverse=True, return_counts=True)
        self.left, self.right = np.divmod(code, size)
        self.numbers = _mixed(hashes[self.left], spelled[self.right]) & NUMBER
        return places, pair

    def phrases(self, parts: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        """Counted phrases, from an array of word numbers for each of their words."""
        spelled = self.words.cast(pa.binary())
        words = [spelled.take(pa.array(self.word[part])) for part in parts]
        phrase = pc.binary_join_element_wise(*words, b" ") if len(words) > 1 else words[0]
        lang = self.langs.take(pa.array(self.lang[parts[0]])).cast(pa.string())
        size = pa.array(np.full(len(counts), len(parts), np.int32))
        return pa.RecordBatch.from_arrays([lang, phrase.view(pa.string()), size, pa.array(counts, pa.int64())], ["lang", "phrase", "words", "f"])


def _counted(docs: DataFrame, count: Callable[[Slice], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``f`` summed over what the slices of all tasks count, by the other columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text", COUNTED_BYTES):
            yield from count(Slice(text_of(piece, "text"), piece.column("lang")))

    found = docs.mapInArrow(run, schema)
    return found.groupBy(*[c for c in found.columns if c != "f"]).agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All phrases of one to LONGEST words that occur ``least`` times or more, and the number of words of each language.

    The first has lang, phrase (words joined by a space), words (how many) and f, the second lang and n. Phrases are counted
    inside pieces, overlaps included. Null texts have no words; a null language is NO_LANGUAGE. Bytes that are not UTF-8
    are word bytes like any others. Rows may repeat.
    """
    read = docs.select(docs[f"`{text_col}`"].alias("text"), F.coalesce(docs[f"`{lang_col}`"], F.lit(NO_LANGUAGE)).alias("lang"))
    enough, schema = F.col("f") >= least, "lang string, phrase string, words int, f long"

    def filter_of(shared) -> Filter:
        return Filter(np.frombuffer(shared.value, np.uint64))

    def singles(slice_: Slice) -> Iterator[pa.RecordBatch]:
        yield slice_.phrases([np.arange(len(slice_.counts))], slice_.counts)

    every = stored(_counted(read, singles, schema), "word-counts")
    ones = every.filter(enough)
    frequent_words = share_filter(word_numbers(ones))

    def doubles(slice_: Slice) -> Iterator[pa.RecordBatch]:
        slice_.pairs(filter_of(frequent_words))
        yield pa.RecordBatch.from_arrays([pa.array(slice_.numbers.view(np.int64)), pa.array(slice_.pair_counts, pa.int64())], ["number", "f"])

    frequent_pairs = share_filter(stored(_counted(read, doubles, "number long, f long").filter(enough).select("number"), "pair-numbers"))

    def longer(slice_: Slice) -> Iterator[pa.RecordBatch]:
        """Phrases whose pairs are all frequent, from two words on; each goes on from the one that is a word shorter."""
        places, pair = slice_.pairs(filter_of(frequent_words))
        known = filter_of(frequent_pairs).has(slice_.numbers)
        yield slice_.phrases([slice_.left[known], slice_.right[known]], slice_.pair_counts[known])
        # pair_at[i]: the frequent pair that starts at word i.
        pair_at = np.full(len(slice_.at) + LONGEST, -1, np.int64)
        pair_at[places[known[pair]]] = pair[known[pair]]
        starts = np.flatnonzero(pair_at >= 0)
        name = pair_at[starts]
        for words in range(3, LONGEST + 1):
            last = pair_at[starts + words - 2]
            starts, name, last = starts[last >= 0], name[last >= 0], last[last >= 0]
            _, first, name, counts = np.unique(name * max(1, len(slice_.left)) + last, return_index=True, return_inverse=True, return_counts=True)
            at = starts[first]
            yield slice_.phrases([*[slice_.left[pair_at[at + i]] for i in range(words - 1)], slice_.right[pair_at[at + words - 2]]], counts)

    phrases = _counted(read, longer, schema).filter(enough)
    return stored(ones.unionByName(phrases), "phrase-counts"), every.groupBy("lang").agg(F.sum("f").alias("n"))


def scored(counts: DataFrame) -> DataFrame:
    """Candidates of two words or more with a, l, r, score and ``longest``, the count of their most frequent extension.

    The cut with the lowest score counts, of equal ones the first. A longer candidate around a phrase is at most as frequent
    as the one-word extension between them, so these extensions decide alone. Arithmetic is decimal.
    """
    # substring_index goes by bytes; patterns would change bytes that are not UTF-8.
    cuts = counts.filter("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).selectExpr(
        "*", "substring_index(phrase, ' ', k) AS first", "substring_index(phrase, ' ', k - words) AS rest"
    )
    beginnings = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    endings = counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    parted = cuts.join(beginnings.hint("merge"), ["lang", "first"]).join(endings.hint("merge"), ["lang", "rest"])
    wide = "decimal(20,0)"
    parted = parted.withColumn("score", F.expr(f"cast(2000000 * cast(a AS {wide}) div (cast(l AS {wide}) + r) AS long)"))
    best = parted.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    to_right = cuts.filter("k = words - 1").groupBy("lang", F.col("first").alias("phrase")).agg(F.max("a").alias("longest"))
    to_left = cuts.filter("k = 1").groupBy("lang", F.col("rest").alias("phrase")).agg(F.max("a").alias("longest"))
    longest = to_right.unionByName(to_left).groupBy("lang", "phrase").agg(F.max("longest").alias("longest"))
    joined = best.join(longest.hint("merge"), ["lang", "phrase"], "left")
    return joined.select("lang", "phrase", "a", "best.l", "best.r", "best.score", "longest")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n and score.

    By score descending, a descending and phrase ascending. Tasks rank their own phrases first, so a language's phrases never
    meet as a whole. Languages without candidates have no rows. Other columns are not read.
    """
    counts, totals = phrase_counts(docs, text_col, lang_col, least)
    # 100 * longest may pass 64 bits.
    free = F.col("longest").isNull() | (F.col("longest").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * SHARE)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(counts).filter(free).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), words AS (
  SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\x20\x09]+') IF w <> ''] AS ws FROM pieces
), places AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM words
), counts AS (
  SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, k AS size, count(*) AS f
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang
), cuts AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, size)) AS k FROM counts WHERE size > 1 AND f >= 30
), parts AS (
  SELECT lang, phrase, size, a, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM cuts
), scores AS (
  SELECT p.lang, p.phrase, p.size, p.a, p.k, x.f AS l, y.f AS r, (2000000::HUGEINT * p.a) // (x.f::HUGEINT + y.f) AS score
  FROM parts p JOIN counts x ON x.lang = p.lang AND x.phrase = p.first JOIN counts y ON y.lang = p.lang AND y.phrase = p.rest
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT lang, f, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS phrase
  FROM (SELECT lang, phrase, size, f, unnest(range(1, size)) AS i FROM counts WHERE size > 2 AND f >= 30) q, (SELECT unnest([2, 3, 4]) AS j)
  WHERE j > i AND j <= size AND j - i + 1 < size
), kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM inside s WHERE s.lang = b.lang AND s.phrase = b.phrase AND 100::HUGEINT * s.f >= 80::HUGEINT * b.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
