"""Readers with declared schemas for the silver, gold and reference tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession, functions as F
from pyspark.sql.types import StructType

from dossierlake import constants as C, schemas
from dossierlake.functions import files
from dossierlake.operators.setops import union_by_name


def _or_empty(spark: SparkSession, schema: str, read: Callable[[], DataFrame]) -> DataFrame:
    """What ``read`` returns, or no rows where nothing has been written yet."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_silver(spark: SparkSession, root: str) -> DataFrame:
    """The newest row of each silver key, over all batches."""
    return newest(silver_layers(spark, root)).select(*_names(schemas.SILVER))


def read_gold(spark: SparkSession, root: str, include_reference: bool = False) -> DataFrame:
    """Rows of both risk zones, the newest batch of each document; ``batch_id`` and ``zone`` say where they come from.

    Batch jobs and streams write the same layout. A zone or a batch without
    rows is no error. Files written before a column existed read it as null.
    With ``include_reference`` the manifest and company rows are appended, as a
    one-level wildcard over the zone folders would return them.
    """
    known = F.col("zone").isin(C.STANDARD_ZONE, C.HIGH_RISK_ZONE)
    gold = newest(gold_layers(spark, root)).where(known).select(*_names(schemas.GOLD), "batch_id", "zone")
    if not include_reference:
        return gold
    return union_by_name(gold, read_reference_documents(spark, root), read_reference_companies(spark, root))


def _names(schema: str) -> list[str]:
    return StructType.fromDDL(schema).names


def silver_layers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(merged rows, rows of batches not merged yet)."""
    return _layer(spark, root, MERGED, "*", schemas.SILVER), _layer(spark, root, "", "batch_id=*", schemas.SILVER)


def gold_layers(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`silver_layers`; ``zone`` is a folder in both layers and prunes."""
    schema = schemas.GOLD + ", zone string"
    return _layer(spark, root, MERGED, "*/zone=*", schema), _layer(spark, root, "", "batch_id=*/zone=*", schema)


#: Merged rows, below a folder that names how many buckets there are.
MERGED = "merged"
MERGED_FOLDERS = f"{MERGED}/buckets=*/bucket="


def _layer(spark: SparkSession, root: str, layer: str, folders: str, schema: str) -> DataFrame:
    base = f"{root}/{layer}".rstrip("/")
    pattern, more = (f"{root}/{MERGED_FOLDERS}{folders}", ", buckets int, bucket int") if layer else (f"{root}/{folders}", "")
    declared = schema + schemas.WRITTEN + more
    rows = _or_empty(spark, declared, lambda: spark.read.option("basePath", base).schema(declared).parquet(pattern))
    return rows.withColumns({"_key": files.silver_key(F.col("source_file")), "version": F.coalesce("version", F.lit(0).cast("long"))})


def superseded(batches: DataFrame) -> DataFrame:
    """(_key, batch_id) of rows that a newer batch replaces.

    Only keys, versions and batch ids are read. Which keys several batches hold
    is decided on numbers, combined map-side, and only those few are compared.
    """
    narrow = batches.where(F.col("_key").isNotNull()).select("_key", "batch_id", "version")
    batch = F.xxhash64("batch_id")
    several = narrow.groupBy("_key").agg(
        *[bound(column).alias(f"{name}_{at}") for at, column in (("version", F.col("version")), ("batch", batch)) for name, bound in (("least", F.min), ("most", F.max))]
    ).where("least_version < most_version OR least_batch < most_batch").select("_key")
    rival = narrow.join(several, "_key").distinct().withColumn("order", F.struct("version", "batch_id"))
    winner = rival.groupBy("_key").agg(F.max("order").alias("winner"))
    return rival.join(winner, "_key").where(F.col("order") < F.col("winner")).select("_key", "batch_id")


def newest(layers: tuple[DataFrame, DataFrame]) -> DataFrame:
    """One batch's rows for each silver key: of batches not merged yet the newest, and merged rows no such batch replaces.

    No wide row is shuffled for it unless very many are replaced: what is
    replaced is a list of keys, which Spark broadcasts while it is small. Rows
    without a source file have no key, replace nothing and stay.
    """
    merged, batches = layers
    fresh = batches.join(superseded(batches), ["_key", "batch_id"], "left_anti")
    taken = batches.where(F.col("_key").isNotNull()).select("_key").distinct()
    return fresh.unionByName(merged.join(taken, "_key", "left_anti"), allowMissingColumns=True)


def silver_keys(spark: SparkSession, root: str) -> DataFrame:
    """``key`` of every silver row, each once: a newer row replaces one of its own key, so none is compared for it."""
    merged, batches = silver_layers(spark, root)
    return merged.select("_key").unionByName(batches.select("_key")).select(F.col("_key").alias("key")).distinct()


def routed_keys(spark: SparkSession, root: str) -> DataFrame:
    """``key`` (zone and silver key) of each document that :func:`read_gold` returns; of several zones in one batch any.

    The newest batch of a key is found in the aggregate that makes keys distinct, and merged rows count where there is none.
    """
    merged, batches = gold_layers(spark, root)
    known = F.when(F.col("zone").isin(C.STANDARD_ZONE, C.HIGH_RISK_ZONE), F.col("zone"))
    order = F.struct(F.lit(1).alias("layer"), "version", F.col("batch_id").alias("batch"), known.alias("known"))
    merged_order = F.struct(F.lit(0).alias("layer"), F.lit(0).cast("long").alias("version"), F.lit("").alias("batch"), known.alias("known"))
    rows = merged.select("_key", merged_order.alias("order")).unionByName(batches.select("_key", order.alias("order")))
    newest_zone = rows.where(F.col("_key").isNotNull()).groupBy("_key").agg(F.max("order").alias("last"))
    return newest_zone.where(F.col("last.known").isNotNull()).select(F.concat_ws("/", "last.known", "_key").alias("key"))


def read_reference_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.MANIFEST).parquet(f"{root}/{C.REFERENCE_ZONE}/documents_manifest.parquet")


def read_reference_companies(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.COMPANIES).parquet(f"{root}/{C.REFERENCE_ZONE}/companies.parquet")


def csv_reader(spark: SparkSession, multiline: bool = False) -> DataFrameReader:
    """Files with a header in the usual dialect: a quote inside a quoted field is doubled.

    ``multiline`` also reads fields with line breaks; such files cannot be split.
    """
    return spark.read.option("header", "true").option("escape", '"').option("multiLine", multiline)


def read_manifest_csv(spark: SparkSession, path: str) -> DataFrame:
    """Manifest with header and byte-order mark; every column is text."""
    return csv_reader(spark).schema(schemas.MANIFEST_CSV).csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows as text, so ids keep their leading zeros; empty when the file is absent."""
    return _or_empty(spark, schemas.GROUND_TRUTH, lambda: csv_reader(spark).schema(schemas.GROUND_TRUTH).csv(path))


def read_training_counts(spark: SparkSession, root: str) -> DataFrame:
    """Counts of every batch learned so far, with its ``batch_id``."""
    declared = schemas.TRAINING_COUNTS + ", batch_id string"
    return _or_empty(spark, declared, lambda: spark.read.option("basePath", root).schema(declared).parquet(f"{root}/batch_id=*"))


def read_folded_batches(spark: SparkSession, path: str) -> DataFrame:
    """Names of the batches whose counts have been added up."""
    return _or_empty(spark, "batch_id string", lambda: spark.read.schema("batch_id string").parquet(path))


def read_status_changes(spark: SparkSession, root: str) -> DataFrame:
    """By how much each micro-batch changed the dashboard totals."""
    declared = "valide bigint, fraude bigint"
    return _or_empty(spark, declared, lambda: spark.read.option("recursiveFileLookup", "true").schema(declared).parquet(f"{root}/batch_id=*"))


def read_page_index(spark: SparkSession, root: str) -> DataFrame:
    """The files of a table written page by page: name, rows, and rows before them."""
    declared = "file string, n bigint, before bigint"
    return _or_empty(spark, declared, lambda: spark.read.schema(declared).parquet(f"{root}/index"))


def read_foreign_silver(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Silver files of another writer, whose all-null columns carry no usable type.

    One scan, however many files. The row-by-row reader takes a column without
    values for any declared type, the vectorised one does not; a session of its
    own keeps that setting to this read.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.parquet.enableVectorizedReader", "false")
    return session.read.schema(schemas.SILVER).parquet(*paths)
