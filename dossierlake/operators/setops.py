"""Unions and fan-out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def union_by_name(*tables: DataFrame) -> DataFrame:
    """Union of differently shaped tables; absent columns read as null."""
    return reduce(lambda left, right: left.unionByName(right, allowMissingColumns=True), tables)


def fan_out_variants(documents: DataFrame, file_name: Column, pdf_path: Column, scan_path: Column) -> DataFrame:
    """One row for the PDF and, when it exists, one for the scan, in a single pass.

    Adds variant_filename, degradation and source_dataset_path.
    """

    def variant(name: Column, degradation: str, path: Column) -> Column:
        return F.struct(
            name.alias("filename"), F.lit(degradation).alias("degradation"), path.alias("source_dataset_path")
        )

    scan_name = F.element_at(F.split(scan_path, "/"), -1)
    variants = F.array(
        variant(file_name, "none", pdf_path),
        F.when(scan_path.isNotNull(), variant(scan_name, "scan_degraded", scan_path)),
    )
    return documents.withColumn("variant", F.explode(variants)).where(F.col("variant").isNotNull()).select(
        *[name for name in documents.columns],
        F.col("variant.filename").alias("variant_filename"),
        F.col("variant.degradation").alias("degradation"),
        F.col("variant.source_dataset_path").alias("source_dataset_path"),
    )
