"""Gold backfill and dataset synchronisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.functions import evidence
from dossierlake.session import scratch_path
from dossierlake.sources import bronze, sinks, swap, tables


def repaired(rows: DataFrame) -> DataFrame:
    """Rows of files whose import stamp has a gap, stamped anew; ``rows`` carry ``_file`` and ``_modified``.

    A file holding any row without stamp gets its own modification time on all
    rows. Only the short list of such files is joined back, and Spark
    broadcasts it while it is small.
    """
    stale = rows.where(F.col("gold_imported_at").isNull()).groupBy("_file").agg(F.max("_modified").alias("_stamp"))
    in_utc = F.to_utc_timestamp("_stamp", F.current_timezone())
    text = F.regexp_replace(F.date_format(in_utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.0{6}$", "")
    stamp = F.concat(text, F.lit("+00:00"))
    return (
        rows.join(stale, "_file", "left")
        .withColumn("updated", F.col("_stamp").isNotNull())
        .withColumn("gold_imported_at", F.when(F.col("updated"), stamp).otherwise(F.col("gold_imported_at")))
        .drop("_modified", "_stamp")
    )


def backfill_imported_at(spark: SparkSession, root: str) -> DataFrame:
    """Repair the table where it stands; returns (scanned, updated) file counts.

    Only the folders that hold a stale file are written again, in both layers
    of the table, beside it; then they are swapped in by a journal, which the
    next run finishes where this one is cut short.
    """
    swap.recover(spark, root)
    prepared, counted, touched = swap.prepare(spark, root), [], []
    for layer, rows in zip((tables.MERGED, ""), tables.gold_layers(spark, root)):
        by = ["buckets", "bucket", "zone"] if layer else ["batch_id", "zone"]
        located = rows.drop("_key").select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_modification_time").alias("_modified")) if swap.folders(spark, f"{root}/{layer}".rstrip("/")) else None
        if located is None:
            continue
        stamped = repaired(located)
        counts = stamped.groupBy(*by).agg(
            F.count_distinct("_file").alias("files"), F.count_distinct(F.when(F.col("updated"), F.col("_file"))).alias("stale")
        )
        path = scratch_path(spark, "gold-folders")
        counts.write.parquet(path)
        counts = spark.read.schema(counts.schema).parquet(path)
        counted.append(counts.select("files", "stale"))
        stale = counts.where("stale > 0").select(*by)
        copy = f"{prepared}/{layer}".rstrip("/")
        stamped.join(stale, by, "left_semi").drop("_file", "updated").write.mode("append").partitionBy(*by).parquet(copy)
        touched += [f"{layer}/{name}".lstrip("/") for name in swap.folders(spark, copy, len(by)) if layer or name.startswith("batch_id=")]
    swap.decide(spark, prepared, touched, [])
    swap.finish(spark, root, prepared)
    total = spark.createDataFrame([], "files bigint, stale bigint")
    for counts in counted:
        total = total.unionByName(counts)
    return total.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("scanned"), F.coalesce(F.sum("stale"), F.lit(0)).alias("updated"))


#: Buckets of merged rows; a table keeps the number of its first merge.
BUCKETS = 64


def merge_silver(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int:
    """Fold the batches of a silver table into its buckets; see :func:`merge_batches`."""
    return merge_batches(spark, root, lambda: tables.silver_layers(spark, root), [], buckets)


def merge_gold(spark: SparkSession, root: str, buckets: int = BUCKETS) -> int:
    """Fold the batches of a gold table into its buckets; see :func:`merge_batches`."""
    return merge_batches(spark, root, lambda: tables.gold_layers(spark, root), ["zone"], buckets)


def merge_batches(spark: SparkSession, root: str, layers: Callable[[], tuple[DataFrame, DataFrame]], by: list[str], buckets: int = BUCKETS) -> int:
    """Rewrite the buckets whose keys have newer rows in batches, keep the newest rows, and remove the batches; returns how many.

    Buckets without such keys are neither read nor written. The new buckets are
    written beside the table, rebalanced so that a large one spreads over
    several files, and swapped in by a journal, which the next merge finishes
    where this one is cut short. Readers see the same rows before and after. A
    batch that is written while the merge runs stays for the next one.
    """
    swap.recover(spark, root)
    known = swap.folders(spark, f"{root}/{tables.MERGED}")
    number = int(known[0].split("=")[1]) if known else buckets
    batches = [name.split("=", 1)[1] for name in swap.folders(spark, root) if name.startswith("batch_id=")]
    if not batches:
        return 0
    merged, waiting = layers()
    waiting = waiting.where(F.col("batch_id").isin(batches))
    # Rows without a key are spread by their text.
    spread = F.when(F.col("_key").isNull(), F.xxhash64("ocr_text")).otherwise(F.xxhash64("_key"))
    placed = waiting.withColumns({"buckets": F.lit(number), "bucket": F.pmod(spread, F.lit(number)).cast("int")})
    touched = [row["bucket"] for row in placed.select("bucket").distinct().collect()]
    rows = tables.newest((merged.where(F.col("bucket").isin(touched)), placed)).drop("_key")
    prepared = swap.prepare(spark, root)
    folder = f"{tables.MERGED}/buckets={number}"
    rows.hint("rebalance", "bucket").drop("buckets").write.partitionBy("bucket", *by).parquet(f"{prepared}/{folder}")
    swap.decide(spark, prepared, [f"{folder}/{name}" for name in swap.folders(spark, f"{prepared}/{folder}")], [f"batch_id={name}" for name in batches])
    swap.finish(spark, root, prepared)
    return len(batches)


def sync_dataset(
    manifest: DataFrame,
    companies: DataFrame,
    documents: DataFrame,
    gold_root: str,
    bronze_root: str,
    land: Callable[[DataFrame, str], DataFrame] = bronze.land_objects,
) -> DataFrame:
    """Publish manifest and companies, push the legitimate PDFs that exist and count what was written.

    ``documents`` carries path and content. Only the ``raw`` folder is looked up, so fraud PDFs are never pushed. ``land``
    stores one object per document, or, as ``packs.land_packed``, many in a container.
    """
    sinks.write_manifest(manifest, evidence.parse_bool(F.col("is_fraud")), gold_root)
    sinks.write_companies(companies, gold_root)
    expected = manifest.select(F.concat_ws("/", F.lit("raw"), "company_siret", "filename").alias("path"))
    pushed = land(documents.join(expected, "path", "left_semi").select(F.col("path").alias("key"), "content"), bronze_root)
    return pushed.agg(
        F.count(F.lit(1)).alias("pdfs_bronze"),
        F.lit(True).alias("manifest_gold"),
        F.lit(True).alias("companies_gold"),
    )
