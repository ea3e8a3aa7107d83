"""Gold rows as dashboard items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import display, doctype, files
from dossierlake.functions.text import blank_to_null, finite
from dossierlake.operators.summaries import dashboard_stats, newest_first, status_filter


def clean_numbers(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null."""
    floating = [name for name, kind in df.dtypes if kind in ("double", "float")]
    return df.withColumns({name: finite(F.col(name)) for name in floating}) if floating else df


def enrich(gold: DataFrame) -> DataFrame:
    """Add filename, fraud_summary, status, preview_url and createdAt."""
    score = F.col("fraud_score")
    fallback = F.col("filename") if "filename" in gold.columns else F.lit(None).cast("string")
    # The type is a column of its own, so that it is computed once per row.
    typed = clean_numbers(gold).withColumn("_type", doctype.normalize(F.col("document_type"), F.col("source_file")))
    alerts = display.alerts(F.col("_type"), F.col("siret"), F.col("mentions_expired"))
    return typed.withColumns(
        {
            "filename": F.coalesce(blank_to_null(F.col("source_file")), fallback, F.lit(C.UNKNOWN_FILENAME)),
            "fraud_summary": display.fraud_summary(score, alerts),
            "status": display.api_status(F.col("statut_fraude"), score),
            "preview_url": files.preview_url(F.col("source_file")),
            "createdAt": display.created_at(gold),
        }
    ).drop("_type")


def items(records: DataFrame, fallback_id: str, now: str, base_url: str = "") -> DataFrame:
    """Map records of any shape to the dashboard columns.

    Each field is the first filled one among several candidate columns.
    """
    names = C.DASHBOARD_CANDIDATES
    picked = records.select(
        display.first_filled(records, names["id"], F.col(fallback_id).cast("string")).alias("id"),
        display.first_filled(records, names["filename"], F.lit(C.UNKNOWN_FILENAME)).alias("filename"),
        display.first_filled(records, names["docType"]).alias("docType"),
        display.first_filled(records, names["status"], F.lit("VALIDE"), booleans=("FRAUDE", "VALIDE")).alias("status"),
        display.first_filled(records, names["reason"], F.lit(C.DEFAULT_REASON)).alias("reason"),
        display.first_filled(records, names["createdAt"], F.lit(now)).alias("createdAt"),
        display.first_filled(records, names["previewUrl"], F.lit("")).alias("previewUrl"),
        display.first_filled(records, names["fraudScore"], F.lit("0")).alias("fraudScore"),
    )
    typed = picked.withColumn("docType", F.coalesce("docType", "filename"))
    return typed.select(
        "id",
        "filename",
        doctype.dashboard_type(F.col("docType"), F.col("filename")).alias("docType"),
        display.dashboard_status(F.col("status")).alias("status"),
        "reason",
        "createdAt",
        F.when(F.col("previewUrl") != "", F.concat(F.lit(base_url), "previewUrl")).otherwise("").alias("previewUrl"),
        F.col("reason").alias("fraudSummary"),
        display.dashboard_score(F.col("fraudScore")).alias("fraudScore"),
    )


def with_item_defaults(df: DataFrame, fallback_id: str, now: str) -> DataFrame:
    """Fill the missing fields of items. A FRAUDE status is the cautious default."""
    filled = {name: F.coalesce(name, F.lit(value)) for name, value in C.ITEM_DEFAULTS.items()}
    filled["fraudScore"] = F.coalesce("fraudScore", F.lit(0.0))
    filled["createdAt"] = F.coalesce("createdAt", F.lit(now))
    filled["id"] = F.coalesce("id", F.col(fallback_id).cast("string"))
    return df.withColumns(filled)


def dashboard(gold: DataFrame, now: str, fallback_id: str = "source_file") -> DataFrame:
    """Gold rows sorted newest first, enriched and mapped to items.

    Sorting comes first: the range partitioning samples its input, and only
    the scan is cheap enough to run twice. The projections keep the order.
    """
    created = F.coalesce(display.created_at(gold), F.lit(now))
    return items(enrich(newest_first(gold, display.sortable_time(created), "source_file")), fallback_id, now)


def overview(gold: DataFrame, now: str, wanted: str = "TOUS", fallback_id: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """The items with the status ``wanted``, newest first, and the statistics of all of them.

    The filter is on gold's own columns and comes before the sort, so other rows are not sorted.
    """
    status = display.api_status(F.col("statut_fraude"), F.col("fraud_score"))
    chosen = status_filter(gold.withColumn("status", status), wanted).drop("status")
    return dashboard(chosen, now, fallback_id), dashboard_stats(gold.select(status.alias("status")))
