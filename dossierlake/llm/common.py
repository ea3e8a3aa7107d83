"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.session import scratch_path

#: Fixed value: the white space of the text contracts, U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: The letters that contracts lower-case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(frame: DataFrame, label: str) -> DataFrame:
    """The frame, written once to the shared scratch space and read from there.

    Cuts the lineage: executors lost later repeat only what comes after. The declared schema makes empty tables readable.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, label)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """How many runs of characters other than white space the text holds; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE_RUN))).cast("long")


#: Bytes of text that a Python worker turns into Python objects at a time.
TEXT_BYTES = 2 << 20


def text_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A text column of a batch; ``row.name`` is a field of its column ``row``."""
    outer, _, inner = column.partition(".")
    return batch.column(outer).field(inner) if inner else batch.column(outer)


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches of about ``most`` bytes of text, a row at least."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(text_of(batch, column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            if begin < end:
                yield batch.slice(begin, end - begin)


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column; null is empty, and bytes that are not UTF-8 become U+FFFD, as they do in Spark's own functions."""
    try:
        return [text or "" for text in column.to_pylist()]
    except UnicodeDecodeError:
        wide = pa.types.is_large_string(column.type)
        return [(raw or b"").decode("utf-8", "replace") for raw in column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of the batches of about TEXT_BYTES of text, a row at least, with their texts.

    Bounds a worker's memory by the longest text rather than by the number of rows in a batch.
    """
    for piece in slices(batches, column, TEXT_BYTES):
        yield piece, texts_of(text_of(piece, column))


def with_text(docs: DataFrame, text_col: str, keep: list[str] | None) -> tuple[DataFrame, str]:
    """``docs`` as a column ``row`` with the columns ``keep`` (all if None), and where its text is found."""
    names = docs.columns if keep is None else keep
    row = F.struct(*[docs[f"`{name}`"] for name in names]).alias("row")
    if text_col in names:
        return docs.select(row), f"row.{text_col}"
    return docs.select(row, docs[f"`{text_col}`"].alias("text")), "text"
