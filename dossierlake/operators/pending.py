"""Which files still need work, and which expected outputs are missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import files


def first_keys(keys: DataFrame, limit: int | None, key: str = "key") -> DataFrame:
    """Smallest keys first; a limit plans as a top-k, without a full sort."""
    return keys.orderBy(key).limit(limit) if limit else keys


def pending_bronze(bronze: DataFrame, silver: DataFrame, limit: int | None = None) -> DataFrame:
    """Bronze keys whose silver file does not exist, all of them unless ``limit`` asks for the smallest ones.

    Both tables carry ``key``; :func:`silver_listing` gives the keys of a silver table.
    """
    wanted = bronze.where(files.has_suffix(F.col("key"), C.UPLOAD_SUFFIXES)).select(
        "key", files.silver_key(F.col("key")).alias("silver_key")
    )
    done = silver.select(F.col("key").alias("silver_key"))
    return first_keys(wanted.join(done, "silver_key", "left_anti").select("key", "silver_key"), limit)


def pending_silver(silver: DataFrame, gold: DataFrame, limit: int | None = None) -> DataFrame:
    """Silver keys routed to neither risk zone; :func:`gold_listing` gives the keys of a gold table."""
    routed = gold.where(F.col("key").rlike(f"^({C.STANDARD_ZONE}|{C.HIGH_RISK_ZONE})/")).select(
        files.gold_to_silver_key(F.col("key")).alias("key")
    )
    wanted = silver.where(files.has_suffix(F.col("key"), ["parquet"])).select("key")
    return first_keys(wanted.join(routed, "key", "left_anti"), limit)


def missing_outputs(expected: DataFrame, actual: DataFrame, key: str = "key") -> DataFrame:
    return expected.select(key).join(actual.select(key), key, "left_anti")


def require_outputs(expected: DataFrame, actual: DataFrame, key: str = "key") -> None:
    """Fail, naming a few keys, when an expected output is absent. A row without a key is never found, so it counts as absent."""
    absent = missing_outputs(expected, actual, key).limit(10).collect()
    if absent:
        raise FileNotFoundError("missing outputs: " + ", ".join("(no key)" if row[key] is None else str(row[key]) for row in absent))


def silver_listing(silver: DataFrame) -> DataFrame:
    """``key`` of each silver row, as its one-document file would be named."""
    return silver.select(files.silver_key(F.col("source_file")).alias("key")).distinct()


def gold_listing(gold: DataFrame) -> DataFrame:
    """``key`` of each gold row: its zone and silver key."""
    return gold.where(F.col("source_file").isNotNull()).select(F.concat_ws("/", "zone", files.silver_key(F.col("source_file"))).alias("key")).distinct()
