"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source expects the same number of copies, target / source size. The expected copies are summed along
an order of the source's documents by size, a random offset is added once, and a document is emitted once for each whole
number its share of the sum crosses. Neighbours in the order have nearly the same size, so the words taken stay near the
target, and no document is emitted more often than its expected copies rounded up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dossierlake.llm.common import stored, table, word_count

#: Weights repeat over the sources in order; the mix holds SHARE of all words and at most REPEAT of any document.
WEIGHTS, SHARE, REPEAT = (3, 1, 2), 1.5, 2
SEED = "mix"
#: Above every size band.
TOP_BAND = 4097
#: MD5 of an empty text, which stands for a row without an id.
NO_ID = "d41d8cd98f00b204e9800998ecf8427e"


def _key(source: Column) -> Column:
    """A source's name as a value that is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """``key``, ``source_size`` and ``target`` of each source from rows of ``key``, ``source`` and ``words``.

    Sharing by weight up to a cap has one level: a source gets its cap or weight times the level. Along the sources by
    cap / weight, the level that results if all before are at their cap rises while they are and falls after, so its
    maximum is the level. These windows have one row per source.
    """
    totals = stored(sizes.groupBy("key", "source").agg(F.sum("words").alias("source_size")), "sources")
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((position - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    everything = Window.partitionBy(F.lit(0))
    by_ratio = everything.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    capped, left = F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)), F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))
    levels = weighed.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - capped) / left)
    return levels.select("key", "source_size", F.least("cap", F.col("weight") * F.max("level").over(everything)).alias("target"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """Rows with their size and where they belong in the order of their source: band, slice and cell, then size, hash and id.

    Only the slice that rows without an id fall into has several cells: for each size the rows before them, these rows by
    the hash of their texts, and the rows after them. The order stays what it is without cells, but for rows without an
    id of one size, which are interchangeable.
    """
    column = lambda name: docs[f"`{name}`"]
    text_hash = F.substring(F.md5(F.coalesce(column(text_col).cast("string"), F.lit("")).cast("binary")), 1, 3)
    return docs.select(
        F.struct(*[column(name) for name in keep]).alias("row"), column(id_col).alias("id"),
        _key(column(source_col)).alias("key"), column(source_col).cast("string").alias("source"), word_count(column(text_col)).alias("size"),
        F.md5(F.coalesce(column(id_col).cast("string"), F.lit("")).cast("binary")).alias("hash"),
        F.when(column(id_col).isNull(), text_hash).alias("text_hash"),
    ).withColumns(
        {
            "band": F.expr("length(bin(size)) * 32 + shiftright(size, greatest(length(bin(size)) - 5, 0))"),
            "slice": F.substring("hash", 1, 2),
        }
    ).withColumns(
        {
            "band": F.when(F.col("band") % 2 == 0, F.col("band")).otherwise(F.lit(TOP_BAND) - F.col("band")),
            "cell": F.when(F.col("slice") != NO_ID[:2], "").otherwise(
                F.concat(
                    F.lpad(F.col("size").cast("string"), 19, "0"),
                    F.when(F.col("id").isNull(), F.concat(F.lit("1"), "text_hash")).when(F.col("hash") < NO_ID, "0").otherwise("2"),
                )
            ),
        }
    ).drop("text_hash")


def sample(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
    seed: str = SEED, **shares,
) -> DataFrame:
    """One row per row of ``docs``: ``row`` (the columns ``keep``, or all), ``size``, ``source_size``, ``target`` and ``copies``.

    The order within a source is: size band, slice of the id's hash, size, hash. Every other band comes in ascending order,
    then the ones between in descending order: what the offset gains on the way up it loses on the way down, so small
    sources come near their target too. Bands are a sixteenth of an octave wide, and there are 256 slices to a band, so no window holds more than a 256th of a source's documents of one size. Rows
    without an id share a slice, which is cut further by size and by 4,096 hashes of texts; only rows that share both id and
    text are never parted. The counts of cells of a band are summed in a window, those of bands in one of a few hundred rows. A first pass reads
    the texts for these counts, a second for the draw, so only the columns kept are shuffled. Null texts and texts without
    words have size 0; documents of a source without words get no copy. A null source is a source of its own and comes
    last. Rows equal in id and size are interchangeable. Repeated runs give the same result.
    """
    sized = _sized(docs, id_col, text_col, source_col, docs.columns if keep is None else keep)
    counts = stored(sized.groupBy("key", "source", "band", "slice", "cell").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "slices")
    wanted = targets(counts, **shares)
    bands = counts.groupBy("key", "band").agg(F.sum("n").alias("n"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    band_start = bands.select("key", "band", F.coalesce(F.sum("n").over(before("key").orderBy("band")), F.lit(0)).alias("band_start"))
    slice_start = counts.select("key", "band", "slice", "cell", F.coalesce(F.sum("n").over(before("key", "band").orderBy("slice", "cell")), F.lit(0)).alias("slice_start"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rates = wanted.select(
        "key", "source_size", "target", offset.alias("offset"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )
    starts = stored(slice_start.join(band_start.join(rates, "key"), ["key", "band"]).withColumn("start", F.col("band_start") + F.col("slice_start")).drop("band_start", "slice_start"), "starts")
    within = Window.partitionBy("key", "band", "slice", "cell").orderBy("size", "hash", "id")
    placed = sized.drop("source").withColumn("nth", F.row_number().over(within) - 1).join(starts, ["key", "band", "slice", "cell"]).withColumn("place", (F.col("start") + F.col("nth")).cast("double"))
    crossed = F.floor((F.col("place") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("place") * F.col("rate") + F.col("offset"))
    return placed.select("row", "size", "source_size", "target", F.least(crossed, F.ceil("rate")).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix: each row of ``docs`` as often as it was drawn, with the columns of ``docs``."""
    drawn = sample(docs, **options).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    drawn = sample(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return drawn.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS key, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS hash
  FROM documents),
raised AS (SELECT *, length(bin(size)) * 32 + (size >> greatest(length(bin(size)) - 5, 0)) AS level, substr(hash, 1, 2) AS slice FROM sized),
banded AS (SELECT *, CASE WHEN level % 2 = 0 THEN level ELSE 4097 - level END AS band FROM raised),
totals AS (SELECT key, source, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL),
weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap,
         ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0.0::DOUBLE))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0.0::DOUBLE)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT key, source_size, least(cap, weight * max(level) OVER ()) AS target FROM levels),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix:' || key), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM targets),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY key ORDER BY band, slice, size, hash, doc_id) - 1)::DOUBLE AS place
  FROM banded JOIN rates USING (key))
SELECT doc_id, size, source_size, target,
       (least(floor((place + 1) * rate + u) - floor(place * rate + u), ceil(rate)) * size)::BIGINT AS taken
FROM placed
"""
