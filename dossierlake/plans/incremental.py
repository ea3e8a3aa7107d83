"""Training batch by batch: counts of each batch are kept, and no labelled row is read twice.

Quantiles and feature counts are sums over rows once the amounts and expiry days themselves are counted, so a model is made
from the counts of all batches, for any day, and equals one training on all their rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake import constants as C, schemas
from dossierlake.functions import doctype, risk
from dossierlake.functions.text import blank_to_null, finite, parse_number
from dossierlake.plans import training
from dossierlake.sources import swap, tables
from dossierlake.sources.sinks import job_batch

FOLDED = "folded"
GROUP = [field.split()[0] for field in schemas.TRAINING_COUNTS.split(", ") if not field.startswith("n ")]


def _entry(kind: Column, **fields: Column) -> Column:
    kinds = dict(field.split() for field in schemas.TRAINING_COUNTS.split(", "))
    known = {"kind": kind, **fields}
    return F.struct(*[known.get(name, F.lit(None)).cast(kinds[name]).alias(name) for name in GROUP])


def batch_counts(ground_truth: DataFrame) -> DataFrame:
    """Occurrences of amounts per level, and per feature and label of what the feature is made of.

    Expiry is counted by day and the amount band by amount, since what they
    mean depends on the day of training and on all other amounts. One pass, combined map-side.
    """
    made = risk.training_features(F.lit(None).cast("date"), F.lit(0.0), F.lit(0.0))
    rows = ground_truth.select(
        blank_to_null(F.col("siret_doc")).alias("siret"),
        doctype.normalize(F.col("doc_type"), F.col("filename")).alias("doc_type"),
        training.label(ground_truth).alias("label"),
        finite(parse_number(F.col("montant_ttc"))).alias("amount"),
        F.col("date_expiration").try_cast("date").alias("day"),
        *[risk.feature_value(name, made[name]).alias(f"f_{name}") for name in C.FEATURES],
    )
    entries = []
    for level, group in training.level_groups().items():
        member = F.col("amount").isNotNull() & group.isNotNull()
        entries.append(F.when(member, _entry(F.lit(level), siret=group["siret"], doc_type=group["doc_type"], amount=F.col("amount"))))
    for name in C.FEATURES:
        if name == "mentions_expired":
            basis = {"day": F.col("day")}
        elif name == "amount_band":
            basis = {"amount": F.col("amount")}
        else:
            basis = {"value": F.col(f"f_{name}")}
        entries.append(_entry(F.lit(name), label=F.col("label"), **basis))
    exploded = rows.select(F.explode(F.array_compact(F.array(*entries))).alias("entry")).select("entry.*")
    return exploded.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n"))


def learn(ground_truth: DataFrame, root: str, batch_id: str, folder: str | None = None) -> None:
    """Keep the counts of one batch below ``root``; a retry replaces its own batch, and no other is read.

    The counts are written beside the table and swapped in by a journal, so a batch counts whole or not at all.
    A batch that :func:`fold` has added to the others cannot be replaced any more: that is an error.
    """
    spark, name = ground_truth.sparkSession, folder or job_batch(batch_id)
    swap.recover(spark, root)
    if not tables.read_folded_batches(spark, f"{root}/{FOLDED}").where(F.col("batch_id") == name).isEmpty():
        raise ValueError(f"the counts of {name} have been folded into others")
    prepared = swap.prepare(spark, root)
    batch_counts(ground_truth).write.parquet(f"{prepared}/batch_id={name}")
    swap.decide(spark, prepared, [f"batch_id={name}"], [])
    swap.finish(spark, root, prepared)


def fold(spark: SparkSession, root: str) -> int:
    """Add the counts of all batches up into one; returns how many were folded. Models stay the same.

    The journal puts the sums, the list of what they hold and the removal of
    the batches in one swap, so no batch is lost or counted twice.
    """
    swap.recover(spark, root)
    known = [name for name in swap.folders(spark, root) if name.startswith("batch_id=")]
    names = [name.split("=", 1)[1] for name in known]
    fresh = [name for name in names if name != FOLDED]
    if not fresh:
        return 0
    counts = tables.read_training_counts(spark, root).where(F.col("batch_id").isin(names))
    prepared = swap.prepare(spark, root)
    counts.groupBy(*GROUP).agg(F.sum("n").alias("n")).write.parquet(f"{prepared}/batch_id={FOLDED}")
    held = tables.read_folded_batches(spark, f"{root}/{FOLDED}").unionByName(spark.createDataFrame([(name,) for name in fresh], "batch_id string"))
    held.coalesce(1).write.parquet(f"{prepared}/{FOLDED}")
    swap.decide(spark, prepared, [f"batch_id={FOLDED}", FOLDED], [f"batch_id={name}" for name in fresh])
    swap.finish(spark, root, prepared)
    return len(fresh)


def feature_counts(counts: DataFrame, bounds: DataFrame, as_of: str) -> DataFrame:
    """Rows per (feature, value, label), as ``training.feature_counts`` gives them, on the day ``as_of``."""
    limits = training.amount_quantiles(bounds).select(F.struct("q_low", "q_mid")).scalar()
    kept = counts.where(F.col("kind").isin(C.FEATURES)).withColumn("limits", limits)
    expired = risk.feature_value("mentions_expired", F.coalesce(F.col("day") < F.lit(as_of).cast("date"), F.lit(False)))
    band = risk.amount_band(F.col("amount"), F.col("limits.q_low"), F.col("limits.q_mid"))
    value = F.when(F.col("kind") == "mentions_expired", expired).when(F.col("kind") == "amount_band", band).otherwise(F.col("value"))
    return kept.groupBy(F.col("kind").alias("feature"), value.alias("value"), "label").agg(F.sum("n").alias("n"))


def train(spark: SparkSession, root: str, as_of: str, path: str) -> training.FraudModel:
    """The model of all batches learned below ``root``, persisted below ``path``; without any it is the neutral one."""
    swap.recover(spark, root)
    counts = tables.read_training_counts(spark, root)
    amounts = counts.where(F.col("kind").isin(training.LEVELS)).select(
        F.col("kind").alias("level"), "siret", "doc_type", F.col("amount").alias("value"), "n"
    )
    return training.fit(spark, path, training.bounds_from_counts(amounts), lambda bounds: feature_counts(counts, bounds, as_of))
