"""From raw documents to token ids: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns the columns of ``docs``; the last
one returns them without the text, and with token ids. Null texts stay null until the last stage, where they have no tokens.
Rows may repeat, tables may be empty, and further columns are carried along, but for those that the last stage names itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.llm import bpe, line_dedup, mixing, near_copies, toxicity
from dossierlake.llm.common import stored, table


#: What the last stage puts in place of the text.
TOKEN_COLUMNS = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled documents of ``sf_dir``, does not reject."""
    return toxicity.drop_toxic(spark, docs, sf_dir)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that many of them share; ``n_chars`` follows the text."""
    cut = line_dedup.drop_repeated_lines(docs)
    text = F.when(F.col("row.text").isNull(), F.col("row.text")).otherwise(F.col("kept"))
    changed = {"text": text, "n_chars": F.when(F.col("row.text").isNull(), F.col("row.n_chars")).otherwise(F.length("kept").cast("long")) if "n_chars" in docs.columns else None}
    return cut.select(*[(F.col(f"row.`{c}`") if changed.get(c) is None else changed[c]).alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the row with the smallest id; rows near no other stay, whatever their ids."""
    return near_copies.survivors(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``n_tokens``, packed token ``ids`` and a hash of what the ids decode to, in place of the text.

    Columns of ``docs`` that have one of these names, in whatever case, give way to the new ones.
    """
    vocabulary = bpe.share_vocabulary(spark, bpe.vocabulary_path())
    coded = bpe.encode_and_decode(docs, vocabulary, keep=[c for c in docs.columns if c.lower() not in {"text", *TOKEN_COLUMNS}])
    new = [F.col("n_tokens"), F.col("ids"), F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256)]
    return coded.select("row.*", *[column.alias(name) for name, column in zip(TOKEN_COLUMNS, new, strict=True)])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", tokenise),
]

#: SQL expresses neither the learned grammar nor fingerprints and merges; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
