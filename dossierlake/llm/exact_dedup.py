"""Exact duplicates by content-defined chunk recipes, in DataFrame operations only.

Each text is cut where its content says so, each chunk becomes an identifier, and texts are compared as ordered lists of
identifiers. The text itself is read once and never shuffled: eight bytes per chunk move instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierlake.llm.common import stored, table

#: A chunk ends at the first line end or full stop after MIN_CHUNK characters, at MAX_CHUNK characters at the latest.
MIN_CHUNK, MAX_CHUNK = 1024, 8192


def _chunks(text: Column, shortest: int, longest: int) -> Column:
    pattern = rf"(?s).{{{shortest - 1},{longest - 1}}}?[\n.]|.{{1,{longest}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK,
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per row of ``docs``: id, ``text_sha256``, ``encoding`` and ``recipe``, the ordered list of verified chunk identifiers.

    An identifier is the chunk's 64-bit hash and a rank. Distinct chunks (told apart by SHA-256) that share a hash get
    different ranks, so equal recipes of one ``encoding`` mean equal texts. Ranks other than 0 are listed in ``ranks`` with
    their position. Null texts are empty; an empty text has an empty recipe. Texts that are not UTF-8 are cut as Latin-1, a
    letter for each byte, and have another ``encoding``, so they are told apart by their bytes.
    """
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    valid = F.is_valid_utf8(text)
    letters = F.when(valid, text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1"))
    cut = docs.select(
        docs[f"`{id_col}`"].alias("id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.when(valid, "UTF-8").otherwise("bytes").alias("encoding"), _chunks(letters, shortest, longest).alias("chunks"),
    )
    base = stored(
        cut.select(
            "id", "text_sha256", "encoding",
            F.transform("chunks", lambda c: chunk_hash(c)).alias("recipe"),
            F.transform("chunks", lambda c: F.unhex(F.sha2(c.cast("binary"), 256))).alias("digests"),
        ),
        "recipes",
    )
    named = base.select(F.explode(F.arrays_zip("recipe", "digests")).alias("c")).select(F.col("c.recipe").alias("hash"), F.col("c.digests").alias("digest")).distinct()
    shared = named.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    ranked = stored(
        named.join(shared, "hash").groupBy("hash").agg(F.array_sort(F.collect_list("digest")).alias("sorted")).select("hash", F.posexplode("sorted").alias("rank", "digest")),
        "shared-hashes",
    ).filter("rank > 0")
    if ranked.isEmpty():
        return base.select("id", "text_sha256", "encoding", "recipe", F.expr("cast(array() as array<struct<pos:int,rank:int>>)").alias("ranks"))
    # Rows with one id and one SHA-256 have one text, so this pair may name a row.
    found = (
        base.select("id", "text_sha256", F.posexplode(F.arrays_zip("recipe", "digests")).alias("pos", "c"))
        .select("id", "text_sha256", "pos", F.col("c.recipe").alias("hash"), F.col("c.digests").alias("digest"))
        .join(ranked, ["hash", "digest"])
        .groupBy(F.col("id").alias("found_id"), F.col("text_sha256").alias("found_sha"))
        .agg(F.array_sort(F.collect_set(F.struct("pos", "rank"))).alias("found"))
    )
    return base.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("text_sha256") == F.col("found_sha")), "left").select(
        "id", "text_sha256", "encoding", "recipe", F.coalesce("found", F.expr("cast(array() as array<struct<pos:int,rank:int>>)")).alias("ranks")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal texts the largest id stays. Rows that repeat an id and a text count in ``group_size`` and share ``kept``; a
    null id stays only where its group has no other, and is compared like any value. Further columns of ``docs`` are not
    read. Groups are counted map-side; only groups of two or more are joined back, and the join may be split by size.
    """
    listed = recipes(docs, id_col, text_col, **options)
    groups = stored(
        listed.groupBy("encoding", "recipe", "ranks").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1"),
        "equal-texts",
    )
    joined = listed.join(groups, ["encoding", "recipe", "ranks"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        "id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
