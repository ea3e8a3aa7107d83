"""Joins of documents to the trained statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import risk
from dossierlake.plans.training import amount_quantiles, feature_column


def with_company_bounds(df: DataFrame, bounds: DataFrame, siret: Column, doc_type: Column) -> DataFrame:
    """Add ``company_low`` and ``company_high``.

    The bounds grow with the number of companies, so nothing is hinted: below
    Spark's size threshold they are broadcast, above it both sides shuffle, and
    adaptive execution splits a company that holds too many of the documents.
    """
    named = bounds.select(
        F.col("siret").alias("_siret"), F.col("doc_type").alias("_kind"), F.col("p5").alias("company_low"), F.col("p95").alias("company_high")
    )
    return df.join(named, (siret == F.col("_siret")) & (doc_type == F.col("_kind")), "left").drop("_siret", "_kind")


def with_outlook(df: DataFrame, bounds: DataFrame, outlook: DataFrame) -> DataFrame:
    """Add the seven features and what the model says of their combination.

    The outlook has one row per possible combination, 768 in all, so it is
    broadcast at any data size. The two amount limits come as constants.
    """
    limits = amount_quantiles(bounds).select(F.struct("q_low", "q_mid")).scalar()
    features = risk.scoring_features(F.col("_limits")["q_low"], F.col("_limits")["q_mid"])
    named = [column.alias(feature_column(name)) for name, column in features.items()]
    described = df.withColumn("_limits", limits).select(*df.columns, *named)
    return described.join(F.broadcast(outlook), [feature_column(name) for name in features], "left")


def required_fields(doc_type: Column) -> Column:
    """Comma-joined required fields; unknown types require nothing."""
    pairs = []
    for name, fields in C.REQUIRED_FIELDS.items():
        pairs += [F.lit(name), F.lit(",".join(fields))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), doc_type), F.lit(""))
