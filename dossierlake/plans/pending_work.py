"""Jobs over what is still to do: listings are compared, only pending documents are read, and every output is looked for."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierlake.functions import files
from dossierlake.operators import pending
from dossierlake.plans.bronze_silver import bronze_to_silver
from dossierlake.plans.scoring import silver_to_gold
from dossierlake.plans.training import FraudModel
from dossierlake.session import scratch_path
from dossierlake.sources import bronze, packs, sinks, tables
from dossierlake.streaming.pipelines import without_ocr


def _noted(keys: DataFrame) -> DataFrame:
    """The work of one run, written down: listings change while it is done."""
    path = scratch_path(keys.sparkSession, "pending")
    keys.write.parquet(path)
    return keys.sparkSession.read.schema(keys.schema).parquet(path)


def extract_pending(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    batch_id: str,
    recognise: Callable[[DataFrame], DataFrame] = without_ocr,
    limit: int | None = None,
    packed: bool = False,
) -> int:
    """Extract the bronze objects whose silver key has no row yet, as one silver batch; returns how many objects.

    All of them, or the ``limit`` smallest keys. ``packed`` says that objects lie in containers (``sources/packs.py``); in
    either layout the bytes of other objects are not read. Of two objects with one silver key the smaller gives the row, and
    the other is not pending afterwards. The job fails where a key it set out to make is missing at the end; a run that is
    repeated after a failure finds the same work, or what is left of it.
    """
    listed = packs.listing(spark, bronze_root) if packed else bronze.list_keys(spark, bronze_root)
    work = _noted(pending.pending_bronze(listed, tables.silver_keys(spark, silver_root), limit))
    count = work.count()
    if not count:
        return 0
    chosen = listed.join(work.select("key"), "key", "left_semi")
    found = packs.with_content(spark, bronze_root, chosen) if packed else bronze.fetch_objects(chosen, bronze_root)
    silver = bronze_to_silver(recognise(found.select(F.col("key").alias("source_file"), "content")))
    sinks.write_silver(silver, silver_root, batch_id, check=True)
    expected = work.select(F.col("silver_key").alias("key")).distinct()
    pending.require_outputs(expected, tables.silver_keys(spark, silver_root))
    return count


def score_pending(
    spark: SparkSession,
    silver_root: str,
    gold_root: str,
    model: FraudModel,
    batch_id: str,
    imported_at: str | None = None,
    limit: int | None = None,
) -> int:
    """Score and route the silver rows that are in neither risk zone yet, as one gold batch; returns how many silver keys.

    Rows without a source file have no key and are never pending. The job fails where a key it set out to route is missing at
    the end.
    """
    work = _noted(pending.pending_silver(tables.silver_keys(spark, silver_root), tables.routed_keys(spark, gold_root), limit))
    count = work.count()
    if not count:
        return 0
    keyed = tables.read_silver(spark, silver_root).withColumn("_silver_key", files.silver_key(F.col("source_file")))
    rows = keyed.join(work.select(F.col("key").alias("_silver_key")), "_silver_key", "left_semi").drop("_silver_key")
    stamp = imported_at or datetime.now(timezone.utc).isoformat()
    sinks.write_gold(silver_to_gold(rows, model, stamp), gold_root, batch_id, check=True)
    routed = tables.routed_keys(spark, gold_root).select(files.gold_to_silver_key(F.col("key")).alias("key"))
    pending.require_outputs(work, routed)
    return count
