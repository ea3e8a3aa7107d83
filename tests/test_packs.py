"""Objects in containers, and the jobs over what is pending."""

import os

import pytest
from pyspark.sql import functions as F

from dossierlake.plans import maintenance, pending_work, training
from dossierlake.sources import bronze, packs, sinks, tables

OBJECTS = "key string, content binary"


def objects(spark, rows, parts=2):
    return spark.createDataFrame(rows, OBJECTS).repartition(parts)


def names(root, folder):
    return sorted(n for n in os.listdir(f"{root}/{folder}") if not n.endswith(".crc"))


def test_objects_come_back_whole_and_the_latest_counts(spark, folder):
    root = folder("packs")
    assert packs.scan_packed(spark, root).count() == 0
    big = bytes(range(256)) * 20_000
    first = packs.land_packed(objects(spark, [("a.pdf", b"old"), ("b/c d.PNG", None), ("big.jpg", big), ("notes.txt", b"x")]), root)
    assert sorted(map(tuple, first.collect())) == [("a.pdf", 3), ("b/c d.PNG", 0), ("big.jpg", len(big)), ("notes.txt", 1)]
    packs.land_packed(objects(spark, [("a.pdf", b"newer"), ("a.pdf", b"newer")]), root)
    found = {r["key"]: (r["length"], bytes(r["content"])) for r in packs.scan_packed(spark, root).collect()}
    assert found == {"a.pdf": (5, b"newer"), "b/c d.PNG": (0, b""), "big.jpg": (len(big), big)}
    assert [r["key"] for r in packs.listing(spark, root, ["txt"]).collect()] == ["notes.txt"]


def test_few_containers(spark, folder):
    root, rolled = folder("packs"), folder("packs")
    rows = spark.range(5000).select(F.concat("id", F.lit(".pdf")).alias("key"), F.encode(F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")), "UTF-8").alias("content"))
    packs.land_packed(rows.coalesce(3), root)
    assert len(names(root, "data")) == 3 and packs.scan_packed(spark, root).agg(F.sum(F.length("content"))).first()[0] == 5000 * 49 // 2
    packs.land_packed(rows.coalesce(1), rolled, pack_bytes=20_000)
    assert len(names(rolled, "data")) == 7 and packs.scan_packed(spark, rolled).count() == 5000


def test_a_failed_job_leaves_nothing_to_see(spark, folder):
    root = folder("packs")
    packs.land_packed(objects(spark, [("kept.pdf", b"1")]), root)
    rows = spark.range(1000, numPartitions=4).select(F.concat("id", F.lit(".pdf")).alias("key"), F.lit(b"x").alias("content"))
    broken = rows.withColumn("key", F.when(F.col("key") != "990.pdf", F.col("key")))
    with pytest.raises(Exception, match="object without a key"):
        packs.land_packed(broken, root)
    assert [r["key"] for r in packs.listing(spark, root).collect()] == ["kept.pdf"] and len(names(root, "commits")) == 1


def test_an_uncommitted_container_is_not_read(spark, folder):
    """As a task leaves it whose job was lost before the commit."""
    root = folder("packs")
    packs.land_packed(objects(spark, [("a.pdf", b"1")], 1), root)
    lost = packs.PackWriter(packs._prepared(spark, root), "lost", 100)
    message = lost.write(iter(objects(spark, [("a.pdf", b"22"), ("b.pdf", b"3")], 1).toArrow().to_batches()))
    assert len(message.parts) == 1 and len(names(root, "index")) == 2
    assert {r["key"]: bytes(r["content"]) for r in packs.scan_packed(spark, root).collect()} == {"a.pdf": b"1"}
    lost.abort([message, None])
    assert len(names(root, "index")) == len(names(root, "data")) == 1


def test_sync_into_containers(spark, folder):
    manifest = spark.createDataFrame([("a.pdf", "facture", "1", "A", "False", ""), ("b.pdf", "kbis", "1", "A", "False", "")], "filename string, doc_type string, company_siret string, company_name string, is_fraud string, fraud_type string")
    companies = spark.createDataFrame([], "siren string, siret string, nom string, adresse string, code_postal string, ville string, naf string, forme_juridique string, dirigeant string, tva_intra string")
    documents = spark.createDataFrame([("raw/1/a.pdf", b"A"), ("raw_fraud/1/b.pdf", b"B")], "path string, content binary")
    root = folder("packs")
    assert maintenance.sync_dataset(manifest, companies, documents, folder("gold"), root, packs.land_packed).first()["pdfs_bronze"] == 1
    assert [r["key"] for r in packs.listing(spark, root).collect()] == ["raw/1/a.pdf"]


@pytest.mark.parametrize("packed", [True, False])
def test_pending_objects_are_extracted_once(spark, folder, packed):
    root, silver = folder("bronze"), folder("silver")
    land = (lambda rows: packs.land_packed(rows, root)) if packed else (lambda rows: bronze.land_objects(rows, root).collect())
    land(objects(spark, [("a.pdf", b"facture one"), ("a.png", b"twin"), ("b.pdf", b"devis"), ("c.txt", b"no")]))
    run = lambda batch, **options: pending_work.extract_pending(spark, root, silver, batch, packed=packed, **options)
    assert run("0", limit=1) == 1 and run("1") == 1 and run("2") == 0  # a.png is claimed by a.pdf
    land(objects(spark, [("d.jpg", b"late")]))
    assert run("3") == 1
    rows = {r["source_file"]: r["ocr_text"] for r in tables.read_silver(spark, silver).collect()}
    assert set(rows) == {"a.pdf", "b.pdf", "d.jpg"} and "facture one" in rows["a.pdf"]


def test_pending_rows_are_scored_once(spark, folder):
    silver, gold, model = folder("silver"), folder("gold"), training.neutral(spark)
    rows = spark.createDataFrame([(f"{i}.pdf" if i else None, "e", "facture", None, None, False, "t") for i in range(4)], "source_file string, ocr_engine string, document_type string, siret string, amount_total double, mentions_expired boolean, ocr_text string")
    sinks.write_silver(rows, silver, "0")
    assert [pending_work.score_pending(spark, silver, gold, model, b, "now") for b in "01"] == [3, 0]
    sinks.write_silver(rows.where("source_file = '1.pdf'").withColumn("source_file", F.lit("5.pdf")), silver, "1")
    assert pending_work.score_pending(spark, silver, gold, model, "2", "now") == 1
    assert sorted(r["source_file"] for r in tables.read_gold(spark, gold).collect()) == ["1.pdf", "2.pdf", "3.pdf", "5.pdf"]


def test_pending_rows_are_listed_by_one_join(spark, folder, monkeypatch):
    """Which of a key's rows is the newest matters to nobody who lists keys, so versions are not joined for it."""
    silver, gold, plans = folder("silver"), folder("gold"), []
    rows = spark.createDataFrame([(f"{i}.pdf", "e", "facture", None, None, False, "t") for i in range(4)], "source_file string, ocr_engine string, document_type string, siret string, amount_total double, mentions_expired boolean, ocr_text string")
    noted = pending_work._noted
    monkeypatch.setattr(pending_work, "_noted", lambda keys: plans.append(keys._jdf.queryExecution().optimizedPlan().toString()) or noted(keys))
    for batch in "01":
        sinks.write_silver(rows, silver, batch)
        pending_work.score_pending(spark, silver, gold, training.neutral(spark), batch, "now")
        sinks.write_silver(rows.withColumn("source_file", F.concat(F.lit("new"), "source_file")), silver, f"{batch}b")
    assert plans[1].count("Join") == 1
    assert pending_work.score_pending(spark, silver, gold, training.neutral(spark), "2", "now") == 0
    assert tables.read_gold(spark, gold).count() == 8
