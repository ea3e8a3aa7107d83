"""Streams drain in bounded batches, restart without repeating work, and redo a batch into the same folder."""

import os

import pandas as pd

from dossierlake import schemas
from pyspark.sql import functions as F

from dossierlake.functions import display
from dossierlake.operators.summaries import dashboard_stats
from dossierlake.plans import maintenance, training
from dossierlake.sources import bronze, sinks, tables
from dossierlake.streaming import pipelines, statistics


def land(spark, root, names):
    rows = [(name, f"Total TTC {i}0.00 facture SIRET 12345678901234".encode()) for i, name in enumerate(names, 1)]
    bronze.land_objects(spark.createDataFrame(rows, "key string, content binary"), root).collect()


def drain(spark, root, silver, checkpoint, batch_size=5):
    stream = pipelines.stream_bronze_to_silver(spark, root, silver, checkpoint, batch_size=batch_size, trigger=pipelines.DRAIN)
    stream.awaitTermination()
    return stream


def batches(path):
    return sorted((name for name in os.listdir(path) if name.startswith("batch_id=stream-")), key=lambda name: int(name.rsplit("-", 1)[1]))


def test_bronze_stream_batches_and_restart(spark, folder):
    root, silver, checkpoint = folder("bronze"), folder("silver"), folder("checkpoint")
    land(spark, root, [f"d/{i}.pdf" for i in range(7)])
    drain(spark, root, silver, checkpoint)
    assert [name[-2:] for name in batches(silver)] == ["-0", "-1"]
    sizes = [spark.read.parquet(f"{silver}/{name}").count() for name in batches(silver)]
    assert sizes == [5, 2]
    drain(spark, root, silver, checkpoint)
    assert [name[-2:] for name in batches(silver)] == ["-0", "-1"]

    land(spark, root, ["d/new.png", "d/skip.docx"])
    drain(spark, root, silver, checkpoint)
    rows = tables.read_silver(spark, silver).collect()
    assert sorted(r["source_file"] for r in rows) == sorted([f"d/{i}.pdf" for i in range(7)] + ["d/new.png"])
    assert {r["ocr_engine"] for r in rows} == {"fallback_text_reader (ModuleNotFoundError)"}
    assert {r["siret"] for r in rows} == {"12345678901234"}


def test_an_unfinished_batch_is_redone_in_place(spark, folder):
    root, silver, checkpoint = folder("bronze"), folder("silver"), folder("checkpoint")
    land(spark, root, [f"{i}.pdf" for i in range(6)])
    drain(spark, root, silver, checkpoint)
    last = max(int(name) for name in os.listdir(f"{checkpoint}/commits") if name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        if os.path.exists(f"{checkpoint}/commits/{name}"):
            os.remove(f"{checkpoint}/commits/{name}")
    drain(spark, root, silver, checkpoint)
    assert tables.read_silver(spark, silver).count() == 6


def test_silver_stream_scores_and_routes(spark, folder):
    silver, gold, checkpoint = folder("silver"), folder("gold"), folder("checkpoint")
    rows = [
        ("11111111111111_facture_1.pdf", "doctr", "invoice", "1", 10.0, True, "x"),
        ("11111111111111_rib_2.pdf", "doctr", "unknown", "1", None, False, "x"),
    ]
    spark.createDataFrame(rows, schemas.SILVER).write.parquet(f"{silver}/batch_id=job-0")
    for _ in range(2):
        stream = pipelines.stream_silver_to_gold(
            spark, silver, gold, checkpoint, training.neutral(spark), "now", trigger=pipelines.DRAIN
        )
        stream.awaitTermination()
    found = {r["source_file"]: (r["fraud_score"], r["zone"]) for r in tables.read_gold(spark, gold).collect()}
    assert found == {
        "11111111111111_facture_1.pdf": (0.9, "high-risk"), "11111111111111_rib_2.pdf": (0.05, "standard"),
    }


def test_no_limit_unless_asked_for(spark, folder):
    root, silver = folder("bronze"), folder("silver")
    land(spark, root, [f"{i}.pdf" for i in range(12)])
    drain(spark, root, silver, folder("checkpoint"), batch_size=None)
    assert len(batches(silver)) == 1 and tables.read_silver(spark, silver).count() == 12


def test_a_later_object_takes_the_silver_key(spark, folder):
    root, silver, checkpoint = folder("bronze"), folder("silver"), folder("checkpoint")
    land(spark, root, ["d/a.pdf", "d/b.pdf"])
    drain(spark, root, silver, checkpoint)
    land(spark, root, ["d/a.jpg", "d/c.pdf", "d/c.png"])
    drain(spark, root, silver, checkpoint)
    assert sorted(r["source_file"] for r in tables.read_silver(spark, silver).collect()) == ["d/a.jpg", "d/b.pdf", "d/c.pdf"]


def test_whole_texts_are_kept(spark, folder):
    root, silver = folder("bronze"), folder("silver")
    bronze.land_objects(spark.createDataFrame([("a.pdf", b"x" * 20_000)], "key string, content binary"), root).collect()
    drain(spark, root, silver, folder("checkpoint"))
    assert len(tables.read_silver(spark, silver).first()["ocr_text"]) == 20_000


def test_an_empty_silver_file_does_not_stop_the_stream(spark, folder):
    root, silver, gold = folder("bronze"), folder("silver"), folder("gold")
    land(spark, root, ["a.docx"])
    drain(spark, root, silver, folder("checkpoint"))
    spark.createDataFrame([], schemas.SILVER).write.mode("append").parquet(f"{silver}/batch_id=9")
    checkpoint = folder("checkpoint")
    pipelines.stream_silver_to_gold(spark, silver, gold, checkpoint, training.neutral(spark), "now", trigger=pipelines.DRAIN).awaitTermination()
    assert tables.read_gold(spark, gold).count() == 0


def gold_rows(spark, documents):
    """Gold rows of (source file, status, zone)."""
    rows = [(name, "e", "facture", "1", 1.0, False, "x", 0.1, 0.1, "v", "normal", status, "m", 0, None, zone) for name, status, zone in documents]
    return spark.createDataFrame(rows, schemas.GOLD + ", zone string")


def test_statistics_follow_gold(spark, folder):
    """After each batch the totals equal a full recount: new and repeated documents, late batches, rows without a key, merges."""
    gold, stats, checkpoint = folder("gold"), folder("stats"), folder("checkpoint")

    def totals():
        statistics.stream_dashboard_stats(spark, gold, stats, checkpoint, trigger=pipelines.DRAIN).awaitTermination()
        return statistics.read_stats(spark, stats).first()

    def recount():
        status = display.api_status(F.col("statut_fraude"), F.col("fraud_score"))
        return dashboard_stats(tables.read_gold(spark, gold).select(status.alias("status"))).first()

    assert statistics.read_stats(spark, stats).first() == (0, 0, 0)
    ok, bad = ("VALIDE", "standard"), ("FRAUDE", "high-risk")
    steps = [
        ("a", 5, [("a.pdf", *ok), ("b.pdf", *bad), (None, *ok), (None, *ok)], (4, 3, 1)),
        ("b", 6, [("a.png", *bad), ("c.pdf", *ok), (None, *bad)], (6, 3, 3)),
        ("late", 4, [("a.pdf", *ok), ("c.pdf", *bad), ("d.pdf", None, "standard")], (7, 4, 3)),
        ("empty", 7, [], (7, 4, 3)),
        ("c", 6, [("a.pdf", *ok), ("a.pdf", *bad), ("e.pdf", "VALIDE", "other")], (8, 5, 3)),
    ]
    for name, version, documents, expected in steps:
        sinks.write_gold(gold_rows(spark, documents), gold, name, version=version)
        assert totals() == expected == recount(), name
    assert maintenance.merge_gold(spark, gold, 2) == 5
    sinks.write_gold(gold_rows(spark, [("b.pdf", *ok)]), gold, "d", version=9)
    assert totals() == (8, 6, 2) == recount()


class Kept:
    """The state of one group, as ``change`` sees it."""

    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_a_call_takes_a_bucket_of_documents():
    """A call of Python serves many documents, and each keeps its own newest batch."""
    state = Kept()

    def added(*rows):
        done = list(statistics.change((7,), iter([pd.DataFrame(rows, columns=["key", "version", "batch_id", "valide", "fraude"])]), state))
        return tuple(done[0].iloc[0]) if done else None

    assert added(("a", 5, "x", 1, 0), ("b", 5, "x", 0, 1), (None, 5, "x", 1, 0)) == (2, 1)
    assert added(("a", 4, "late", 0, 1), ("c", 4, "late", 1, 0)) == (1, 0)
    assert added(("b", 6, "y", 1, 0), ("c", 4, "late", 0, 1), (None, 4, "late", 0, 1)) == (1, 1)
    assert added(("a", 5, "w", 0, 1)) is None


def test_a_batch_is_looked_up_in_few_tasks(spark, folder):
    """Not in one task for each of its files; what a session chose itself stays."""
    before = spark.conf.get(pipelines.LISTING_TASKS)
    try:
        for chosen, expected in ((pipelines.ONE_EACH, str(4 * spark.sparkContext.defaultParallelism)), ("3", "3")):
            spark.conf.set(pipelines.LISTING_TASKS, chosen)
            root, silver = folder("bronze"), folder("silver")
            land(spark, root, [f"{i}.pdf" for i in range(40)])
            drain(spark, root, silver, folder("checkpoint"), batch_size=40)
            assert spark.conf.get(pipelines.LISTING_TASKS) == expected and tables.read_silver(spark, silver).count() == 40
    finally:
        spark.conf.set(pipelines.LISTING_TASKS, before)


def test_a_batch_of_small_files_is_dealt_to_few_tasks(spark, folder):
    """Not to one for every few files, each with a file of silver; what a session chose itself stays."""
    names = (pipelines.OPEN_COST, pipelines.REWRITTEN_AFTER, "spark.sql.files.maxPartitionBytes")
    before = {name: spark.conf.get(name) for name in names}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
        for cost, interval, expected in ((pipelines.BY_DEFAULT, pipelines.TEN, (pipelines.SMALL, pipelines.HUNDRED)), ("5000000", "7", ("5000000", "7"))):
            spark.conf.set(pipelines.OPEN_COST, cost)
            spark.conf.set(pipelines.REWRITTEN_AFTER, interval)
            root, silver = folder("bronze"), folder("silver")
            land(spark, root, [f"{i}.pdf" for i in range(60)])
            drain(spark, root, silver, folder("checkpoint"), batch_size=60)
            written = [name for name in os.listdir(f"{silver}/{batches(silver)[0]}") if name.endswith(".parquet")]
            assert (spark.conf.get(pipelines.OPEN_COST), spark.conf.get(pipelines.REWRITTEN_AFTER)) == expected
            assert tables.read_silver(spark, silver).count() == 60
            assert (len(written) <= spark.sparkContext.defaultParallelism) == (expected[0] == pipelines.SMALL)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
