"""Dashboard statistics that follow a gold table without counting it again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dossierlake import constants as C, schemas
from dossierlake.functions import display, files
from dossierlake.sources import tables
from dossierlake.sources.sinks import stream_batch
from dossierlake.streaming.pipelines import EVERY_MINUTE, Trigger, bounded

CHANGES = "valide bigint, fraude bigint"
#: What is remembered of a document: who wrote its newest rows, and how many of them have each status.
KNOWN = pa.schema([("key", pa.string()), ("version", pa.int64()), ("batch_id", pa.string()), ("valide", pa.int64()), ("fraude", pa.int64())])
#: Groups that documents are dealt to by key, each with one state; fixed for the life of a checkpoint. Rows without a key are spread over as many.
BUCKETS = 1024


def _packed(known: dict[str, tuple[int, str, int, int]]) -> bytes:
    columns = [list(known), *(zip(*known.values(), strict=True))]
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, KNOWN) as writer:
        writer.write_table(pa.table([pa.array(column, kind) for column, kind in zip(columns, KNOWN.types, strict=True)], KNOWN))
    return out.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> dict[str, tuple[int, str, int, int]]:
    keys, *values = (column.to_pylist() for column in pa.ipc.open_stream(raw).read_all().columns)
    return dict(zip(keys, zip(*values, strict=True), strict=True))


def change(key: tuple[int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """By how much the rows of one bucket of documents change the totals; rows without a key only add."""
    known = _unpacked(bytes(state.get[0])) if state.exists else {}
    changed, more_valide, more_fraude = False, 0, 0
    for part in parts:
        for name, version, batch_id, valide, fraude in zip(*(part[column].tolist() for column in KNOWN.names), strict=True):
            before = known.get(name, (-1, "", 0, 0)) if isinstance(name, str) else (version, batch_id, 0, 0)
            if (version, batch_id) < before[:2]:
                continue
            kept = before[2:] if (version, batch_id) == before[:2] else (0, 0)
            after = (int(version), batch_id, kept[0] + int(valide), kept[1] + int(fraude))
            more_valide, more_fraude = more_valide + after[2] - before[2], more_fraude + after[3] - before[3]
            if isinstance(name, str):
                known[name], changed = after, True
    if changed:
        state.update((_packed(known),))
    if more_valide or more_fraude:
        yield pd.DataFrame({"valide": [more_valide], "fraude": [more_fraude]})


def stream_dashboard_stats(
    spark: SparkSession, gold_root: str, stats_root: str, checkpoint: str, batch_size: int | None = None, trigger: Trigger = EVERY_MINUTE
) -> StreamingQuery:
    """Keep the totals of ``dashboard_stats`` up to date with the batches of a gold table.

    Each new file is read once, and of its columns only key, score and status.
    State remembers the status that a document's newest batch gave it, so a
    document that is scored again moves from one total to the other, and an
    older batch that arrives late changes nothing. What is written per batch is
    one row of differences, in a folder a redone batch replaces.

    State holds one small row per document, in one value for each of BUCKETS
    buckets of keys, as a call of Python for each document costs far more than
    the document: a batch reads and writes the buckets of its documents. Keep
    it in RocksDB, as ``session.local_session`` does. Checkpoints from before
    there were buckets hold other state: start over from an empty one. A backfill or a repeated batch that writes
    known rows anew counts those again that have no key, so start over
    from an empty checkpoint and folder after one.
    """
    path = F.col("_metadata.file_path")
    reader = bounded(spark.readStream.schema(schemas.GOLD + ", version bigint").option("recursiveFileLookup", "true"), batch_size)
    key = files.silver_key(F.col("source_file"))
    status = display.api_status(F.col("statut_fraude"), F.col("fraud_score"))
    rows = (
        reader.parquet(f"{gold_root}/batch_id=*")
        .where(F.regexp_extract(path, r"/zone=([^/]*)/", 1).isin(C.STANDARD_ZONE, C.HIGH_RISK_ZONE))
        .select(
            key.alias("key"),
            F.pmod(
                F.when(key.isNull(), F.xxhash64(path, F.col("_metadata.file_block_start"), "fraud_score", "siret", "amount_total")).otherwise(F.xxhash64(key)), F.lit(BUCKETS)
            ).alias("bucket"),
            F.coalesce("version", F.lit(0)).cast("long").alias("version"),
            F.regexp_extract(path, r"/batch_id=([^/]*)/", 1).alias("batch_id"),
            (status == "VALIDE").cast("long").alias("valide"),
            (status == "FRAUDE").cast("long").alias("fraude"),
        )
    )
    changes = rows.groupBy("bucket").applyInPandasWithState(change, CHANGES, "known binary", "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, batch_id: int) -> None:
        sums = batch.agg(*[F.coalesce(F.sum(name), F.lit(0)).cast("long").alias(name) for name in ("valide", "fraude")])
        sums.write.mode("overwrite").parquet(f"{stats_root}/batch_id={stream_batch(checkpoint, batch_id)}")

    return changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**trigger).start()


def read_stats(spark: SparkSession, stats_root: str) -> DataFrame:
    """The totals so far, in the shape of ``dashboard_stats``: one row per batch is read, no gold."""
    valide, fraude = (F.coalesce(F.sum(name), F.lit(0)).cast("long") for name in ("valide", "fraude"))
    return tables.read_status_changes(spark, stats_root).agg((valide + fraude).alias("total"), valide.alias("valide"), fraude.alias("fraude"))
