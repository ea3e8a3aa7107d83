"""Score, validate and route silver documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import doctype, risk
from dossierlake.plans.lookups import with_company_bounds, with_outlook
from dossierlake.plans.training import FraudModel, company_bounds


def score(silver: DataFrame, model: FraudModel) -> DataFrame:
    """Add fraud_score, ml_probability, model_version and risk_level.

    The model's outlook is a broadcast of fixed size. The only possible
    shuffle is the company lookup, and only while the company table is too
    large to broadcast.
    """
    described = with_outlook(silver, model.bounds, model.outlook)
    siret = risk.resolve_siret(F.col("siret"), F.col("source_file"))
    kind, expired = F.col("f_doc_type"), F.col("f_mentions_expired")
    rows = with_company_bounds(described, company_bounds(model.bounds), siret, kind)
    rule = risk.rule_score(
        kind, F.col("siret"), F.col("amount_total"), expired, F.col("f_ocr_degraded"), F.col("type_limit"),
        F.col("company_low"), F.col("company_high"),
    )
    return (
        rows.withColumn("_rule", rule)
        .withColumn("_score", risk.blend(F.col("ml"), F.col("_rule"), F.col("type_rate"), expired))
        .select(
            *silver.columns,
            F.round("_score", 4).alias("fraud_score"),
            F.round("ml", 4).alias("ml_probability"),
            "model_version",
            risk.risk_level(F.col("_score")).alias("risk_level"),
        )
    )


def validate(scored: DataFrame) -> DataFrame:
    """Add statut_fraude, motif and ml_flag; decisions use the rounded scores."""
    kind = doctype.normalize(F.col("document_type"), F.col("source_file"))
    found = risk.issues(F.col("_type"), F.col("siret"), F.col("amount_total"), F.col("mentions_expired"))
    return (
        scored.withColumn("_type", kind)
        .withColumns(
            {
                "statut_fraude": risk.verdict(
                    F.col("fraud_score"), F.col("ml_probability"), risk.issue_count(found)
                ),
                "motif": risk.issue_text(found),
                "ml_flag": risk.ml_flag(F.col("fraud_score")),
            }
        )
        .drop("_type")
    )


def route(validated: DataFrame, imported_at: str, file: str | None = None) -> DataFrame:
    """Add the import stamp and the zone.

    A silver file normally holds one document, so the zone is the row's own.
    With ``file`` naming the file column of multi-row files, the highest score
    of the file decides; scores are combined map-side before the join.
    """
    stamped = validated.withColumn("gold_imported_at", F.lit(imported_at))
    if file is None:
        return stamped.withColumn("zone", risk.zone(F.col("fraud_score")))
    high = (
        validated.groupBy(file)
        .agg(F.max("fraud_score").alias("_top"))
        .where(F.col("_top") >= C.HIGH_RISK)
        .select(file, F.lit(C.HIGH_RISK_ZONE).alias("_zone"))
    )
    routed = stamped.join(high, file, "left")
    return routed.withColumn("zone", F.coalesce("_zone", F.lit(C.STANDARD_ZONE))).drop("_zone")


def silver_to_gold(silver: DataFrame, model: FraudModel, imported_at: str, file: str | None = None) -> DataFrame:
    return route(validate(score(silver, model)), imported_at, file)
