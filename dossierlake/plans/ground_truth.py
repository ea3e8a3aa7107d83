"""Labelled ground truth from the manifest, the file listing and the document texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import evidence, files
from dossierlake.functions.text import strip
from dossierlake.operators.paths import resolve_paths, unresolved
from dossierlake.operators.setops import fan_out_variants
from dossierlake.operators.summaries import supported_documents


def build_ground_truth(manifest: DataFrame, listing: DataFrame, texts: DataFrame, skip_missing: bool = False) -> DataFrame:
    """Eleven text columns, one row per PDF and one per scan.

    ``texts`` carries filename, company_siret and text; a row takes its fields
    from the text of its PDF. Texts are reduced to their findings before any
    join, so no document text is ever shuffled, and listing and findings are
    folded together before they meet the manifest on (company, document). A
    manifest row whose PDF is missing stops the job when it is met, unless
    ``skip_missing`` says that such rows, which :func:`missing_documents`
    lists, may be left out.
    """
    fraud = evidence.parse_bool(F.col("is_fraud"))
    findings = texts.select("company_siret", "filename", F.struct(*[column.alias(name) for name, column in evidence.findings(F.col("text")).items()]).alias("findings"))
    resolved = resolve_paths(supported_documents(manifest), listing, fraud, findings)
    present = F.col("pdf_path").isNotNull()
    if not skip_missing:
        named = F.concat_ws("/", F.coalesce("company_siret", F.lit("?")), F.coalesce("filename", F.lit("?")))
        present = F.when(present, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("missing documents: "), named)).cast("boolean"))
    read = resolved.where(present).withColumnRenamed("findings", "found")
    blank = F.lit("")
    found = {
        "shown": F.coalesce("found.shown", F.array().cast("array<string>")),
        "head_office": F.col("found.head_office"),
        **{name: F.coalesce(f"found.{name}", blank) for name in ("ht", "ttc", "valid_until")},
    }
    fields = evidence.fields_by_type(F.col("doc_type"), F.col("company_siret"), found)
    labelled = read.select(
        "filename",
        "doc_type",
        F.when(fraud, "1").otherwise("0").alias("is_fraud"),
        strip(F.coalesce("fraud_type", F.lit(""))).alias("fraud_type"),
        *[column.alias(name) for name, column in fields.items()],
        evidence.group_id(F.col("company_siret")).alias("linked_group_id"),
        "pdf_path",
        "scan_path",
    )
    fanned = fan_out_variants(labelled, F.col("filename"), F.col("pdf_path"), F.col("scan_path"))
    return fanned.drop("filename").withColumnRenamed("variant_filename", "filename").select(*C.GROUND_TRUTH_HEADERS)


def missing_documents(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Supported manifest rows without a PDF."""
    fraud = evidence.parse_bool(F.col("is_fraud"))
    return unresolved(resolve_paths(supported_documents(manifest), listing, fraud))
