"""Writers. All replace their own part only, so a retried job leaves the same result and nothing else changes."""

from __future__ import annotations

import hashlib
import time

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from dossierlake import constants as C, schemas
from dossierlake.functions import display
from dossierlake.operators import verify
from dossierlake.operators.dedup import one_per_silver_key


def _declared(df: DataFrame, schema: str) -> DataFrame:
    fields = StructType.fromDDL(schema)
    return df.select(*[F.col(field.name).cast(field.dataType).alias(field.name) for field in fields])


def job_batch(batch_id: str) -> str:
    """Name of a batch job's folder; streams name theirs otherwise, so neither replaces a batch of the other."""
    return f"job-{batch_id}"


def stream_batch(checkpoint: str, batch_id: int) -> str:
    """Name of a micro-batch's folder: the same when it is redone, another for a stream with another checkpoint."""
    return f"stream-{hashlib.sha256(checkpoint.encode()).hexdigest()[:12]}-{batch_id}"


def _write_batch(rows: DataFrame, schema: str, root: str, folder: str, version: int | None, check: bool, by: list[str]) -> None:
    spark, target = rows.sparkSession, f"{root}/batch_id={folder}"
    stamped = _declared(rows, schema).withColumn("version", F.lit(time.time_ns() // 1000 if version is None else version).cast("long"))
    if not check:
        stamped.write.mode("overwrite").partitionBy(*by).parquet(target)
        return
    written = verify.observed(stamped)
    written.rows.write.mode("overwrite").partitionBy(*by).parquet(target)
    verify.require_same(written, spark.read.option("basePath", target).schema(stamped.schema).option("recursiveFileLookup", str(not by).lower()).parquet(target))


def write_silver(silver: DataFrame, root: str, batch_id: str, version: int | None = None, check: bool = False, folder: str | None = None) -> None:
    """Add one batch of silver rows, one per silver key.

    Of two sources of the batch with the same stem the smaller key stays. A key
    that other batches hold too is read from the one with the highest
    ``version`` (by default the time of writing), so a later result replaces
    an earlier one, and no earlier file is read here. The batch has its own
    folder, which a retry replaces; other batches are not touched. With
    ``check`` the job fails where the files do not hold the rows of the batch.
    """
    _write_batch(one_per_silver_key(silver), schemas.SILVER, root, folder or job_batch(batch_id), version, check, [])


def write_gold(routed: DataFrame, root: str, batch_id: str, version: int | None = None, check: bool = False, folder: str | None = None) -> None:
    """Write one batch of gold rows below its own folder, by zone; each task writes one file per zone at most.

    A retry replaces the batch and nothing else. A document that other batches
    hold too is read from the newest, as in :func:`write_silver`, so scoring it
    again moves it between zones.
    """
    _write_batch(routed, schemas.GOLD + ", zone string", root, folder or job_batch(batch_id), version, check, ["zone"])


def write_ground_truth(rows: DataFrame, path: str) -> None:
    (
        rows.select(*C.GROUND_TRUTH_HEADERS)
        .write.mode("overwrite")
        .option("header", "true")
        .option("escape", '"')
        .option("emptyValue", "")
        .csv(path)
    )


def write_manifest_csv(manifest: DataFrame, is_fraud: Column, path: str) -> None:
    """Manifest for the ground-truth job: the folder follows the label, booleans print capitalised."""
    columns = {
        "is_fraud": F.when(is_fraud, "True").otherwise("False"),
        "folder": F.when(is_fraud, "raw_fraud").otherwise("raw"),
    }
    rows = manifest.withColumns(columns).select(*C.MANIFEST_COLUMNS, "folder")
    rows.write.mode("overwrite").option("header", "true").option("escape", '"').option("emptyValue", "").csv(path)


def write_manifest(manifest: DataFrame, is_fraud: Column, gold_root: str) -> None:
    """Manifest as a reference table, with a boolean label and without the folder."""
    rows = manifest.withColumn("is_fraud", is_fraud).select(*C.MANIFEST_COLUMNS)
    rows.write.mode("overwrite").parquet(f"{gold_root}/{C.REFERENCE_ZONE}/documents_manifest.parquet")


def write_companies(companies: DataFrame, gold_root: str) -> None:
    """The ten published company columns; a blank VAT number is derived."""
    rows = companies.withColumn("tva_intra", display.vat_number(F.col("siren"), F.col("tva_intra")))
    rows.select(*C.COMPANY_COLUMNS).write.mode("overwrite").parquet(
        f"{gold_root}/{C.REFERENCE_ZONE}/companies.parquet"
    )
