"""Reports: invoice totals, counts, statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import files, risk


def invoice_totals(lines: DataFrame) -> DataFrame:
    """Pre-tax total, tax and total per invoice, in exact decimals.

    ``lines`` carries invoice_id, quantite, prix_unitaire_ht and taux_tva. The rate is
    one per invoice.
    """
    line_total = F.round(F.col("quantite") * F.col("prix_unitaire_ht"), 2).cast("decimal(18,2)")
    per_invoice = lines.groupBy("invoice_id").agg(
        F.sum(line_total).alias("total_ht"), F.max("taux_tva").alias("taux_tva")
    )
    ht = F.round("total_ht", 2).cast("decimal(18,2)")
    tva = F.round(F.col("total_ht") * F.col("taux_tva"), 2).cast("decimal(18,2)")
    return (
        per_invoice.withColumn("montant_tva", tva)
        .withColumn("total_ht", ht)
        .withColumn("total_ttc", (F.col("total_ht") + F.col("montant_tva")).cast("decimal(18,2)"))
        .select("invoice_id", "total_ht", "montant_tva", "total_ttc")
    )


def dashboard_stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "VALIDE").alias("valide"),
        F.count_if(F.col("status") == "FRAUDE").alias("fraude"),
    )


def endpoint_envelope(df: DataFrame, message: str | None = None) -> DataFrame:
    """Status word and row count of an endpoint; ``message`` appears only when empty."""
    counted = df.agg(F.count(F.lit(1)).alias("count"))
    empty = F.col("count") == 0
    columns = [F.when(empty, "empty").otherwise("success").alias("status"), F.col("count")]
    if message is not None:
        columns.append(F.when(empty, message).alias("message"))
    return counted.select(*columns)


def upload_summary(uploads: DataFrame, name: str = "name", written: Column | None = None) -> DataFrame:
    """Accepted and failed counts of each upload batch.

    ``uploads`` carries ``batch``; ``written`` says whether storing an accepted file succeeded.
    A batch without a single success is an error.
    """
    ok = files.upload_rejection(F.col(name), written).isNull()
    counted = uploads.groupBy("batch").agg(
        F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")
    )
    status = (
        F.when(F.col("successful") == 0, "error").when(F.col("failed") > 0, "partial_success").otherwise("success")
    )
    message = F.concat(
        F.col("successful").cast("string"), F.lit(" fichier(s) securise(s), "), F.col("failed").cast("string"),
        F.lit(" echec(s)."),
    )
    return counted.select("batch", "successful", "failed", status.alias("status"), message.alias("message"))


def dataset_summary(manifest: DataFrame, is_fraud: Column) -> DataFrame:
    """Documents per type, per fraud type, and both grand totals, from one aggregation."""
    counts = (
        manifest.select("doc_type", "fraud_type", is_fraud.alias("fraud"))
        .groupBy("doc_type", "fraud_type", "fraud")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    entries = F.array(
        F.struct(F.lit("documents").alias("section"), F.lit("total").alias("item"), F.col("n").alias("n")),
        F.struct(F.lit("type").alias("section"), F.col("doc_type").alias("item"), F.col("n").alias("n")),
        F.struct(
            F.lit("frauds").alias("section"), F.lit("total").alias("item"), F.when(F.col("fraud"), F.col("n"))
            .otherwise(F.lit(0)).alias("n"),
        ),
        F.when(
            F.col("fraud"),
            F.struct(F.lit("fraud_type").alias("section"), F.col("fraud_type").alias("item"), F.col("n").alias("n")),
        ),
    )
    return (
        counts.select(F.explode(F.array_compact(entries)).alias("entry"))
        .groupBy(F.col("entry.section").alias("section"), F.col("entry.item").alias("item"))
        .agg(F.sum("entry.n").alias("n"))
    )


def file_summary(scored: DataFrame, file: str = "source_file", order: str = "row_no") -> DataFrame:
    """Route of each file by its highest score, with the score and level of its first row."""
    return scored.groupBy(file).agg(
        risk.zone(F.max("fraud_score")).alias("zone"),
        F.min_by("fraud_score", order).alias("fraud_score"),
        F.min_by("risk_level", order).alias("risk_level"),
    )


def status_filter(items: DataFrame, wanted: str) -> DataFrame:
    """TOUS keeps everything, VALIDE and FRAUDE keep their own rows."""
    return items if wanted == "TOUS" else items.where(F.col("status") == wanted)


def supported_documents(manifest: DataFrame) -> DataFrame:
    return manifest.where(F.col("doc_type").isin(C.DOC_TYPES))


def newest_first(items: DataFrame, created_at: Column, tie: str) -> DataFrame:
    return items.orderBy(created_at.desc(), F.col(tie))
