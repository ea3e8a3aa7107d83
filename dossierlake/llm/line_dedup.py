"""Repeated lines found through a sharded minimal perfect hash.

Lines that many documents share are counted by hash. Each shard of their hashes gets a minimal perfect hash: a few bits a
line, and arrays of fingerprint, count and keeper at the number it gives. Documents send the hashes of their lines, never the
lines, to the shards, and each task streams past one shard's arrays at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierlake.llm.common import SPACE, ascii_lower, stored, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Most line hashes in a shard (on average), and how many shards there are for each shuffle partition at least.
SHARD_KEYS, SHARDS_EACH = 100_000, 16


def _mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """Another 64-bit hash of a line for each level."""
    x = h1 ^ (h2 * np.uint64(2 * level + 1)) ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """A minimal perfect hash in levels of bits.

    A level has one bit a key that is left. Keys alone at their bit set it, the others go on to the next level. A key's
    number is how many bits are set before its own. Absent keys get some number or -1, so fingerprints must be compared.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.starts = np.concatenate(([0], np.cumsum((sizes + 63) // 64)))
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        """From distinct pairs of hashes."""
        sizes, words = [], []
        while len(h1):
            size = len(h1) + len(h1) // 2 + 1
            at = (_mixed(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros((size + 63) // 64 * 64, np.uint8)
            bits[:size] = alone
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.zeros(0, "<u8"))

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        live = np.arange(len(h1))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(live):
                break
            at = (_mixed(h1[live], h2[live], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.starts[level] + at // 64, (at % 64).astype(np.uint64)
            here = self.words[word] >> bit & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[live[here]] = (self.before[word] + np.bitwise_count(below))[here]
            live = live[~here]
        return out


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def occurrences(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """``id``, ``text_hash``, ``h1``, ``h2``: two hashes of each distinct long line of each row."""
    keys = F.array_distinct(F.filter(F.transform(_lines(docs[f"`{text_col}`"]), line_key), lambda k: F.length(k) >= min_chars))
    long_lines = docs.select(docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("text_hash"), F.explode(keys).alias("key"))
    return long_lines.select("id", "text_hash", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """One row per shard of ``h1``, ``h2``, ``n``, ``keep``: the perfect hash and its arrays."""
    keep_type = frequent.schema["keep"].dataType
    schema = T.StructType(
        [T.StructField("shard", T.IntegerType()), T.StructField("sizes", T.BinaryType()), T.StructField("bits", T.BinaryType()),
         T.StructField("fingerprints", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("keepers", T.ArrayType(keep_type))]
    )

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        h1, h2 = (rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        perfect = PerfectHash.build(h1, h2)
        order = np.argsort(perfect.find(h1, h2))
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()), "sizes": [perfect.sizes.astype("<i8").tobytes()], "bits": [perfect.words.tobytes()],
                "fingerprints": [h2[order].tobytes()], "counts": [rows.column("n").to_numpy()[order].astype("<i8").tobytes()],
                "keepers": pa.array([rows.column("keep").combine_chunks().take(pa.array(order)).to_pylist()], pa.list_(rows.column("keep").type)),
            }
        )

    return frequent.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(build, schema)


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("h1", 17), F.lit(shards)).cast("int")


def probe(lines: DataFrame, index: DataFrame, heavy: DataFrame, shards: int) -> DataFrame:
    """``lines`` (``id``, ``text_hash``, ``h1``, ``h2``) that the index holds, with ``n`` and ``keep``.

    ``heavy`` has a number of copies for the shards whose lines are very frequent; such a shard is read by as many tasks.
    """
    keep = index.schema["keepers"].dataType.elementType
    salted = lines.withColumn("shard", _shard(shards)).join(F.broadcast(heavy), "shard", "left")
    salted = salted.withColumn("salt", F.pmod(F.xxhash64("id", "text_hash", "h1"), F.coalesce("copies", F.lit(1))).cast("int"))
    arrays = index.join(F.broadcast(heavy), "shard", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int") - 1)))
    parts = ["sizes", "bits", "fingerprints", "counts", "keepers"]
    absent = {name: F.lit(None).cast(index.schema[name].dataType) for name in parts}
    asked = salted.select("shard", "salt", F.lit(1).alias("kind"), "id", "text_hash", "h1", "h2", *[c.alias(n) for n, c in absent.items()])
    given = arrays.select("shard", "salt", F.lit(0).alias("kind"), F.lit(None).cast(lines.schema["id"].dataType).alias("id"), F.lit(0).cast("long").alias("text_hash"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), *parts)
    dealt = given.unionByName(asked).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    schema = T.StructType([lines.schema["id"], T.StructField("text_hash", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("keep", keep)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect = fingerprints = counts = keepers = None
        held = (-1, -1)
        for batch in batches:
            shard, salt, kind = (batch.column(c).to_numpy() for c in ("shard", "salt", "kind"))
            place = shard.astype(np.int64) << 32 | salt
            cuts = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (kind[1:] == 0)))).tolist() + [batch.num_rows]
            h1, h2 = (batch.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
            for begin, end in zip(cuts, cuts[1:], strict=False):
                here = (shard[begin], salt[begin])
                if kind[begin] == 0:
                    row = {name: batch.column(name)[begin] for name in parts}
                    perfect = PerfectHash(np.frombuffer(row["sizes"].as_py(), "<i8"), np.frombuffer(row["bits"].as_py(), "<u8"))
                    fingerprints, counts = np.frombuffer(row["fingerprints"].as_py(), "<u8"), np.frombuffer(row["counts"].as_py(), "<i8")
                    keepers, held = row["keepers"].values, here
                    begin += 1
                if begin == end or held != here:
                    continue
                number = perfect.find(h1[begin:end], h2[begin:end])
                hit = np.flatnonzero((number >= 0) & (fingerprints[np.maximum(number, 0)] == h2[begin:end]))
                if len(hit):
                    chosen, number = pa.array(hit + begin), number[hit]
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(c).take(chosen) for c in ("id", "text_hash", "h1")), pa.array(counts[number]), keepers.take(pa.array(number))], ["id", "text_hash", "h1", "n", "keep"]
                    )

    return dealt.mapInArrow(run, schema)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS
) -> DataFrame:
    """``id``, ``text_hash``, ``h1``: the lines, by hash, that each document loses."""
    spark = docs.sparkSession
    lines = occurrences(docs, id_col, text_col, min_chars)
    frequent = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keep")).filter(F.col("n") >= min_docs), "frequent-lines")
    size = frequent.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("hits")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(math.ceil(size["keys"] / shard_keys), SHARDS_EACH * partitions)
    index = stored(build_index(frequent, shards), "line-index")
    # At most as many shards exceed this share of all hits as there are shares, so the list of them is small.
    share = max(1, math.ceil(size["hits"] / (SHARDS_EACH * partitions)))
    copies = F.ceil(F.sum("n") / F.lit(share)).cast("int")
    heavy = stored(frequent.groupBy(_shard(shards).alias("shard")).agg(copies.alias("copies")).filter("copies > 1"), "heavy-shards")
    return probe(lines, index, heavy, shards).filter(~F.col("id").eqNullSafe(F.col("keep"))).select("id", "text_hash", "h1")


def lost_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``lost_id``, ``lost_hash``, ``lost``: the lines that a document loses, no more than it has, also where many have no id."""
    lost = repeated_lines(docs, id_col, text_col, **options).groupBy("id", "text_hash").agg(F.collect_set("h1").alias("lost"))
    return lost.withColumnRenamed("id", "lost_id").withColumnRenamed("text_hash", "lost_hash")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``n_lines``, ``n_dropped`` and ``kept``, the text that stays.

    A line's key is the line without white space at its ends and with A-Z in lower case. Keys of ``min_chars`` code points
    or more in at least ``min_docs`` documents lose all their lines except in the document with the largest id. Each row is
    a document of its own for the count; rows that share an id are treated alike, and null ids keep a line only where no
    other id has it. Null and empty texts are one empty line. A document that loses all its lines keeps an empty text.
    Keys are told apart by 128 bits of hash.
    """
    lost = lost_lines(docs, id_col, text_col, **options)
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("text_hash"))
    joined = row.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    min_chars = options.get("min_chars", MIN_CHARS)
    lines = _lines(F.col(f"row.`{text_col}`"))
    stays = lambda line: (F.length(line_key(line)) < min_chars) | ~F.array_contains("lost", F.xxhash64(line_key(line)))
    cut = joined.select("row", "lost", F.size(lines).cast("long").alias("n_lines"), F.when(F.col("lost").isNull(), lines).otherwise(F.filter(lines, stays)).alias("left"))
    return cut.select("row", "n_lines", (F.col("n_lines") - F.size("left")).alias("n_dropped"), F.array_join("left", "\n").alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH split_docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM split_docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, f.keep IS NOT NULL AND f.keep <> k.doc_id AS dropped FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
