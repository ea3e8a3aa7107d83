"""The dashboard page by page: sorted once, each page read from the few files that hold it.

The table is written newest first, and an index with one row per file says at which place of the order the file begins. A row's
place is that number and its row number in the file, so any page is found without sorting or counting the pages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dossierlake import schemas
from dossierlake.functions import display
from dossierlake.plans.dashboard import enrich, items
from dossierlake.sources import swap, tables

PLACE = "_place"
#: Rows a file of pages holds at most, since a page opens whole files.
PER_FILE = 1_000_000


def write_pages(gold: DataFrame, root: str, now: str, per_file: int = PER_FILE) -> None:
    """Write gold rows below ``root`` in the order of the dashboard, and the index of the files.

    Rows without a stamp count as ``now``. Rows of one time are ordered by
    source file, then by their contents, so that no time and no missing name
    holds more rows than one task can sort. Another run replaces the table by a
    journal. The index has one row per file; its running count is one window over these.
    """
    spark = gold.sparkSession
    swap.recover(spark, root)
    prepared = swap.prepare(spark, root)
    created = F.coalesce(display.created_at(gold), F.lit(now))
    kept = [field.split()[0] for field in schemas.GOLD.split(", ")]
    order = [display.sortable_time(created).desc(), F.col("source_file").asc_nulls_first(), F.xxhash64(*kept)]
    gold.select(*kept).orderBy(*order).write.option("maxRecordsPerFile", per_file).parquet(f"{prepared}/rows")
    written = spark.read.schema(schemas.GOLD).parquet(f"{prepared}/rows")
    # Parts are numbered in the order of their ranges, and files of a part in the order they were written.
    numbers = [F.regexp_extract("file", pattern, 1).cast("int") for pattern in (r"^part-(\d+)-", r"-c(\d+)\.")]
    counted = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy(*numbers).rowsBetween(Window.unboundedPreceding, -1))
    counted.select("file", "n", F.coalesce(before, F.lit(0)).cast("long").alias("before")).write.parquet(f"{prepared}/index")
    swap.decide(spark, prepared, ["rows", "index"], [])
    swap.finish(spark, root, prepared)


def count_pages(spark: SparkSession, root: str, size: int) -> int:
    """How many pages of ``size`` rows there are."""
    rows = tables.read_page_index(spark, root).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return -(-rows // size)


def page_rows(spark: SparkSession, root: str, number: int, size: int) -> DataFrame:
    """Gold rows of one page in order, pages counted from 0; no rows beyond the last one.

    Only the files that hold the page are opened; there are at most ``size`` of them.
    """
    if number < 0 or size < 1:
        raise ValueError("pages are counted from 0 and hold a row at least")
    first, end = number * size, (number + 1) * size
    index = tables.read_page_index(spark, root)
    held = index.where((F.col("before") < end) & (F.col("before") + F.col("n") > first)).collect()
    if not held:
        return spark.createDataFrame([], schemas.GOLD)
    starts = spark.createDataFrame([(row["file"], row["before"]) for row in held], "_file string, _before bigint")
    rows = spark.read.schema(schemas.GOLD).parquet(*[f"{root}/rows/{row['file']}" for row in held])
    located = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    placed = located.join(F.broadcast(starts), "_file").withColumn(PLACE, F.col("_before") + F.col("_index"))
    return placed.where((F.col(PLACE) >= first) & (F.col(PLACE) < end)).orderBy(PLACE).drop("_file", "_index", "_before", PLACE)


def page(spark: SparkSession, root: str, number: int, size: int, now: str) -> DataFrame:
    """Dashboard items of one page; ``now`` as given when the pages were written."""
    return items(enrich(page_rows(spark, root, number, size)), "source_file", now)
