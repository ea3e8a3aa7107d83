"""Incremental jobs: a file source, a checkpoint, and one replaceable folder per batch."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamReader, StreamingQuery

from dossierlake import constants as C, schemas
from dossierlake.functions import files
from dossierlake.plans.bronze_silver import bronze_to_silver
from dossierlake.plans.scoring import silver_to_gold
from dossierlake.plans.training import FraudModel
from dossierlake.sources.bronze import relative_key, suffix_glob
from dossierlake.sources.sinks import stream_batch, write_gold, write_silver

Trigger = dict[str, object]
EVERY_MINUTE: Trigger = {"processingTime": "1 minute"}
DRAIN: Trigger = {"availableNow": True}


#: Setting and Spark's default for the tasks that look up a batch's files: one task a file, which costs more than the batch itself.
LISTING_TASKS, ONE_EACH = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"
#: Setting and Spark's default for what opening a file counts as, and what it counts as here: by 4 MB a task would take 32 documents at most.
OPEN_COST, BY_DEFAULT, SMALL = "spark.sql.files.openCostInBytes", str(4 << 20), str(64 << 10)
#: Setting, Spark's default and what holds here for the batches after which the list of all files read so far is written anew.
REWRITTEN_AFTER, TEN, HUNDRED = "spark.sql.streaming.fileSource.log.compactInterval", "10", "100"


def list_in_few_tasks(spark: SparkSession) -> None:
    """Let the tasks that look up a batch's files take many files each, a few tasks a core, unless the session says how many."""
    if spark.conf.get(LISTING_TASKS, ONE_EACH) == ONE_EACH:
        spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))


def deal_in_few_tasks(spark: SparkSession) -> None:
    """Deal a batch's files to a task a core while they are small, unless the session says what opening one counts as.

    A task writes one file, so silver gets as many files a batch, and all readers of silver open fewer. Large files and large
    batches are still cut by size.
    """
    if spark.conf.get(OPEN_COST, BY_DEFAULT).removesuffix("b") == BY_DEFAULT:
        spark.conf.set(OPEN_COST, SMALL)


def rewrite_list_rarely(spark: SparkSession) -> None:
    """The list of files read so far grows with the stream, and so do its rewritings: one in a hundred batches, unless the session says how many."""
    if spark.conf.get(REWRITTEN_AFTER, TEN) == TEN:
        spark.conf.set(REWRITTEN_AFTER, HUNDRED)


def bounded(reader: DataStreamReader, files_per_batch: int | None) -> DataStreamReader:
    """The reader with a limit of files per batch where one is asked for."""
    return reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)


def without_ocr(objects: DataFrame) -> DataFrame:
    """Stand-in for a missing OCR model: every document falls back to its bytes."""
    return objects.withColumns(
        {"ocr_text": F.lit(None).cast("string"), "ocr_error": F.lit("ModuleNotFoundError")}
    )


def stream_bronze_to_silver(
    spark: SparkSession,
    bronze_root: str,
    silver_root: str,
    checkpoint: str,
    recognise: Callable[[DataFrame], DataFrame] = without_ocr,
    batch_size: int | None = None,
    trigger: Trigger = EVERY_MINUTE,
) -> StreamingQuery:
    """Extract each new bronze object once.

    The checkpoint replaces the comparison of listings: a restart continues
    after the last finished batch, and a batch cut short is redone into the
    same folder. A batch reads no earlier silver: of the rows of one silver key
    readers take the newest batch's. Every write is checked by sums. All new
    objects make one batch unless ``batch_size`` limits its files.
    """
    list_in_few_tasks(spark)
    deal_in_few_tasks(spark)
    rewrite_list_rarely(spark)
    reader = spark.readStream.format("binaryFile").schema(schemas.BRONZE).option("recursiveFileLookup", "true")
    objects = (
        bounded(reader, batch_size)
        .option("pathGlobFilter", suffix_glob(C.UPLOAD_SUFFIXES))
        .load(bronze_root)
        .select(relative_key(F.col("path"), bronze_root).alias("source_file"), "content")
        .where(files.has_suffix(F.col("source_file"), C.UPLOAD_SUFFIXES))
    )
    silver = bronze_to_silver(recognise(objects))

    def write(batch: DataFrame, batch_id: int) -> None:
        write_silver(batch, silver_root, str(batch_id), check=True, folder=stream_batch(checkpoint, batch_id))

    return silver.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()


def stream_silver_to_gold(
    spark: SparkSession,
    silver_root: str,
    gold_root: str,
    checkpoint: str,
    model: FraudModel,
    imported_at: str | None = None,
    batch_size: int | None = None,
    trigger: Trigger = EVERY_MINUTE,
) -> StreamingQuery:
    """Score, validate and route each new silver file of the batches once, and check by sums that every row arrived.

    Merging batches (``plans.maintenance``) removes their folders, so merge only what this stream has read.
    """
    silver = bounded(spark.readStream.schema(schemas.SILVER).option("recursiveFileLookup", "true"), batch_size).parquet(f"{silver_root}/batch_id=*")

    def write(batch: DataFrame, batch_id: int) -> None:
        stamp = imported_at or datetime.now(timezone.utc).isoformat()
        write_gold(silver_to_gold(batch, model, stamp), gold_root, str(batch_id), check=True, folder=stream_batch(checkpoint, batch_id))

    return silver.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()
