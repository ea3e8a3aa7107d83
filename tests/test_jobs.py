"""Sources, sinks, pending work, deduplication and maintenance."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dossierlake import schemas
from dossierlake.operators import dedup, paths, pending, summaries
from dossierlake.plans import checks, dashboard, ground_truth, maintenance, paging, scoring
from dossierlake.sources import bronze, companies, sinks, swap, tables


def keys(spark, *names):
    return spark.createDataFrame([(name,) for name in names], "key string")


def test_landed_objects_are_scanned_back(spark, folder):
    root = folder("bronze")
    rows = [("a b/x.PDF", b"\x00\xff"), ("a b/y.txt", b"t"), ("z.jpeg", b"z")]
    landed = bronze.land_objects(spark.createDataFrame(rows, "key string, content binary"), root)
    assert {(r["key"], r["length"]) for r in landed.collect()} == {("a b/x.PDF", 2), ("a b/y.txt", 1), ("z.jpeg", 1)}
    found = {r["key"]: bytes(r["content"]) for r in bronze.scan_bronze(spark, root).collect()}
    assert found == {"a b/x.PDF": b"\x00\xff", "z.jpeg": b"z"}
    assert [r["key"] for r in bronze.list_keys(spark, root).collect()] == ["a b/x.PDF", "z.jpeg"]


def test_manifest_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "manifest.csv"
    path.write_text("﻿filename,doc_type,company_siret,company_name,is_fraud,fraud_type,folder\n"
                    "a.pdf,rib,00012345678901,Société,True,iban_invalide,raw_fraud\n", encoding="utf-8")
    row = tables.read_manifest_csv(spark, str(path)).collect()[0]
    assert (row["filename"], row["company_siret"], row["is_fraud"]) == ("a.pdf", "00012345678901", "True")


def test_missing_ground_truth_reads_empty(spark, folder):
    assert tables.read_ground_truth(spark, folder("nowhere")).count() == 0


def test_foreign_file_with_null_typed_columns(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = tmp_path / "one.parquet"
    pq.write_table(pa.table({"source_file": ["a.pdf"], "siret": pa.nulls(1), "amount_total": pa.nulls(1)}), path)
    other = tmp_path / "two.parquet"
    pq.write_table(pa.table({"source_file": ["b.pdf"], "siret": ["0123"], "amount_total": [1.5]}), other)
    rows = tables.read_foreign_silver(spark, [str(path), str(other)]).collect()
    assert sorted((r["source_file"], r["siret"], r["amount_total"], r["ocr_text"]) for r in rows) == [
        ("a.pdf", None, None, None), ("b.pdf", "0123", 1.5, None),
    ]
    assert spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true"
    found = tables.read_foreign_silver(spark, [str(path), str(other)])
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    joined = spark.createDataFrame([("b.pdf", 1)], "source_file string, n int").join(found, "source_file")
    assert joined.count() == 1


def test_pending_work(spark):
    found = pending.pending_bronze(
        keys(spark, "b.pdf", "a.PNG", "c.jpg", "d.txt", "e.pdf"), keys(spark, "c.parquet"), limit=2
    )
    assert [r["key"] for r in found.collect()] == ["a.PNG", "b.pdf"]
    silver, gold = keys(spark, "a.parquet", "b.parquet", "c.parquet"), keys(
        spark, "standard/a.parquet", "high-risk/b.parquet", "other/c.parquet", "c.parquet"
    )
    assert [r["key"] for r in pending.pending_silver(silver, gold).collect()] == ["c.parquet"]


def test_missing_outputs_raise(spark):
    pending.require_outputs(keys(spark, "a"), keys(spark, "a", "b"))
    with pytest.raises(FileNotFoundError, match="b"):
        pending.require_outputs(keys(spark, "a", "b"), keys(spark, "a"))


def test_first_row_wins(spark):
    rows = spark.createDataFrame([("k", 2, "late"), ("k", 1, None), ("x", 5, "only")], "k string, o int, v string")
    assert {tuple(r) for r in dedup.first_per_key(rows, ["k"], ["o"]).collect()} == {("k", 1, None), ("x", 5, "only")}


def test_one_row_per_silver_key(spark):
    rows = spark.createDataFrame(
        [("a.png", 1), ("a.pdf", 2), ("b.pdf", 3), ("a.jpg", 4), ("c.pdf", 9), ("c.pdf", 7), ("d.pdf", 5), ("d.pdf", 5)], "source_file string, v int"
    )
    found = [tuple(r) for r in dedup.one_per_silver_key(rows).collect()]
    assert sorted(found) == [("a.jpg", 4), ("b.pdf", 3), ("c.pdf", 7), ("d.pdf", 5)]
    assert dedup.one_per_silver_key(rows.limit(0)).count() == 0


def test_deciding_silver_keys_runs_no_job(spark):
    """The plan is built without an action, a limit or a hint."""
    rows = spark.createDataFrame([("a.png", 1), ("a.pdf", 2)], "source_file string, v int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "")
    plan = dedup.one_per_silver_key(rows)._jdf.queryExecution().executedPlan().toString()
    assert not tracker.getJobIdsForGroup("plan-only") and "GlobalLimit" not in plan
    spark.sparkContext.setJobGroup("tests", "")


def silver_rows(spark, *rows):
    full = [(name, "doctr", "invoice", "1", 1.0, False, text) for name, text in rows]
    return spark.createDataFrame(full, schemas.SILVER)


def test_silver_batches_add_up_and_the_newest_wins(spark, folder):
    root = folder("silver")
    sinks.write_silver(silver_rows(spark, ("d/a.pdf", "first"), ("d/b.pdf", "first"), ("d/z.pdf", "first")), root, "0")
    for text in ("second", "retried"):
        sinks.write_silver(silver_rows(spark, ("d/a.png", text), ("d/b.pdf", text), ("d/c.pdf", text), (None, text)), root, "1")
    sinks.write_silver(silver_rows(spark, ("d/b.pdf", "too old")), root, "2", version=5)
    want = [("None", "retried"), ("d/a.png", "retried"), ("d/b.pdf", "retried"), ("d/c.pdf", "retried"), ("d/z.pdf", "first")]
    found = lambda: sorted((str(r["source_file"]), r["ocr_text"]) for r in tables.read_silver(spark, root).collect())
    assert found() == want
    for _ in range(2):  # merging changes nothing that readers see
        maintenance.merge_silver(spark, root, buckets=3)
        assert found() == want and not [n for n in os.listdir(root) if n.startswith("batch_id=")]
    sinks.write_silver(silver_rows(spark, ("d/c.pdf", "newest")), root, "1")
    files_before = {n: os.listdir(f"{root}/merged/buckets=3/{n}") for n in os.listdir(f"{root}/merged/buckets=3")}
    assert ("d/c.pdf", "newest") in found() and len(found()) == 5
    maintenance.merge_silver(spark, root, buckets=7)  # the number of the first merge stays
    assert ("d/c.pdf", "newest") in found() and len(found()) == 5
    changed = [n for n, names in files_before.items() if os.listdir(f"{root}/merged/buckets=3/{n}") != names]
    assert os.listdir(f"{root}/merged") == ["buckets=3"] and len(changed) == 1


def test_equal_versions_are_decided_by_batch(spark, folder):
    root = folder("silver")
    for batch_id in ("b", "a"):
        sinks.write_silver(silver_rows(spark, ("x.pdf", batch_id)), root, batch_id, version=1)
    assert [r["ocr_text"] for r in tables.read_silver(spark, root).collect()] == ["b"]


def test_a_batch_job_and_a_stream_share_a_table(spark, folder):
    from dossierlake.streaming import pipelines

    bronze_root, root = folder("bronze"), folder("silver")
    bronze.land_objects(spark.createDataFrame([(f"{i}.pdf", b"x") for i in range(7)], "key string, content binary"), bronze_root).collect()
    pipelines.stream_bronze_to_silver(spark, bronze_root, root, folder("checkpoint"), trigger=pipelines.DRAIN).awaitTermination()
    sinks.write_silver(silver_rows(spark, ("new.pdf", "job"), ("3.pdf", "job")), root, "0")
    found = {r["source_file"]: r["ocr_text"] for r in tables.read_silver(spark, root).collect()}
    assert len(found) == 8 and found["new.pdf"] == found["3.pdf"] == "job"


def gold_rows(spark, *rows):
    wanted = spark.createDataFrame([], schemas.GOLD).schema
    partial = spark.createDataFrame([(name, score, "high-risk" if score >= 0.75 else "standard") for name, score in rows], "source_file string, fraud_score double, zone string")
    return partial.select(*[F.col(f.name) if f.name in partial.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted], "zone")


def test_scoring_again_moves_a_document_between_zones(spark, folder):
    root = folder("gold")
    sinks.write_gold(gold_rows(spark, ("a.pdf", 0.9), ("b.pdf", 0.1)), root, "0", check=True)
    maintenance.merge_gold(spark, root, buckets=2)
    sinks.write_gold(gold_rows(spark, ("a.pdf", 0.2)), root, "1", check=True)
    want = [("a.pdf", "standard", "job-1"), ("b.pdf", "standard", "job-0")]
    found = lambda: sorted((r["source_file"], r["zone"], r["batch_id"]) for r in tables.read_gold(spark, root).collect())
    assert found() == want
    maintenance.merge_gold(spark, root)
    assert found() == want


class Stop(Exception):
    pass


@pytest.mark.parametrize("at", range(6))
def test_a_merge_cut_short_is_finished_or_undone(spark, folder, monkeypatch, at):
    root = folder("gold")
    sinks.write_gold(gold_rows(spark, ("a.pdf", 0.9), ("b.pdf", 0.1), ("c.pdf", 0.3)), root, "0")
    maintenance.merge_gold(spark, root, buckets=2)
    sinks.write_gold(gold_rows(spark, ("a.pdf", 0.2), ("d.pdf", 0.8)), root, "1")
    want = sorted(map(str, tables.read_gold(spark, root).collect()))
    real, calls = swap.step, []

    def stop(*args):
        if len(calls) == at - 1:
            raise Stop
        calls.append(args)
        real(*args)

    with monkeypatch.context() as patch:
        if at == 0:  # before the journal is written
            patch.setattr(swap, "decide", lambda *args: (_ for _ in ()).throw(Stop()))
        patch.setattr(swap, "step", stop)
        try:
            maintenance.merge_gold(spark, root)
            assert at > len(calls)
        except Stop:
            pass
    finished, dropped = swap.recover(spark, root)
    assert (finished, dropped) in ((1, 0), (0, 1), (0, 0)) and (dropped == 1) == (at == 0)
    assert sorted(map(str, tables.read_gold(spark, root).collect())) == want
    maintenance.merge_gold(spark, root)
    assert sorted(map(str, tables.read_gold(spark, root).collect())) == want and os.listdir(f"{root}/_pending") == []


@pytest.mark.parametrize("at", ["decide", "step"])
def test_a_backfill_cut_short_is_finished_by_the_next(spark, folder, monkeypatch, at):
    root = folder("gold")
    for batch_id in ("0", "1"):
        sinks.write_gold(gold_rows(spark, (f"a{batch_id}.pdf", 0.9), (f"b{batch_id}.pdf", 0.1)), root, batch_id)
        if batch_id == "0":
            maintenance.merge_gold(spark, root, buckets=2)
    with monkeypatch.context() as patch:
        patch.setattr(swap, at, lambda *args: (_ for _ in ()).throw(Stop()))
        with pytest.raises(Stop):
            maintenance.backfill_imported_at(spark, root)
    maintenance.backfill_imported_at(spark, root)
    rows = tables.read_gold(spark, root).collect()
    assert len(rows) == 4 and all(r["gold_imported_at"] for r in rows)


def test_a_lost_or_doubled_row_is_found(spark):
    from dossierlake.operators import verify

    rows = spark.createDataFrame([(i, float("nan") if i == 3 else i / 7, None if i == 4 else f"t{i}") for i in range(50)], "a int, b double, c string")
    for other, same in ((rows.repartition(3), True), (rows.where("a <> 7"), False), (rows.unionByName(rows.where("a = 7")), False), (rows.where("a <> 7").unionByName(rows.where("a = 8")), False)):
        written = verify.observed(rows)
        written.rows.write.format("noop").mode("overwrite").save()
        if same:
            verify.require_same(written, other)
        else:
            with pytest.raises(FileNotFoundError, match="missing outputs"):
                verify.require_same(written, other)


def test_a_missing_output_without_a_key_is_named(spark):
    rows = spark.createDataFrame([(None,), ("a",)], "key string")
    with pytest.raises(FileNotFoundError, match=r"\(no key\)"):
        pending.require_outputs(rows, keys(spark, "a"))


def test_pending_work_comes_from_the_tables(spark, folder):
    silver_root, gold_root = folder("silver"), folder("gold")
    sinks.write_silver(silver_rows(spark, ("d/a.pdf", "x"), ("d/b.png", "x")), silver_root, "0")
    listed = pending.silver_listing(tables.read_silver(spark, silver_root))
    assert [r["key"] for r in pending.pending_bronze(keys(spark, "d/a.pdf", "d/c.pdf"), listed).collect()] == ["d/c.pdf"]
    assert sorted(r["key"] for r in pending.pending_silver(listed, pending.gold_listing(tables.read_gold(spark, gold_root))).collect()) == ["d/a.parquet", "d/b.parquet"]
    gold = tables.read_silver(spark, silver_root).where("source_file = 'd/a.pdf'").withColumn("fraud_score", F.lit(0.9))
    missing = [f for f in spark.createDataFrame([], schemas.GOLD).schema if f.name not in gold.columns]
    gold = gold.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing], F.lit("high-risk").alias("zone"))
    sinks.write_gold(gold, gold_root, "0")
    assert [r["key"] for r in pending.pending_silver(listed, pending.gold_listing(tables.read_gold(spark, gold_root))).collect()] == ["d/b.parquet"]


def test_keys_of_the_tables_are_those_of_their_newest_rows(spark, folder):
    """Over merged rows, several batches, equal versions, an unknown zone and rows without a key."""
    silver, gold = folder("silver"), folder("gold")
    same = lambda: (
        sorted(str(r["key"]) for r in tables.silver_keys(spark, silver).collect()) == sorted(str(r["key"]) for r in pending.silver_listing(tables.read_silver(spark, silver)).collect())
        and sorted(r["key"] for r in tables.routed_keys(spark, gold).collect()) == sorted(r["key"] for r in pending.gold_listing(tables.read_gold(spark, gold)).collect())
    )
    assert same()
    sinks.write_silver(silver_rows(spark, ("d/a.pdf", "x"), ("d/b.png", "x"), (None, "x")), silver, "0")
    sinks.write_gold(gold_rows(spark, ("a.pdf", 0.9), ("b.pdf", 0.1), ("c.pdf", 0.1), (None, 0.9)), gold, "0", version=3)
    assert same()
    maintenance.merge_silver(spark, silver, buckets=2)
    maintenance.merge_gold(spark, gold, buckets=2)
    assert same()
    sinks.write_silver(silver_rows(spark, ("d/b.pdf", "y"), ("d/c.pdf", "y")), silver, "1")
    sinks.write_gold(gold_rows(spark, ("a.pdf", 0.1), ("d.pdf", 0.9), ("e.pdf", 0.9)), gold, "1", version=2)
    sinks.write_gold(gold_rows(spark, ("d.pdf", 0.1)), gold, "2", version=2)
    sinks.write_gold(gold_rows(spark, ("b.pdf", 0.1), ("e.pdf", 0.1)).withColumn("zone", F.lit("elsewhere")), gold, "3", version=4)
    assert same()
    assert sorted(r["key"] for r in tables.routed_keys(spark, gold).collect()) == ["standard/a.parquet", "standard/c.parquet", "standard/d.parquet"]


def test_gold_without_one_zone_and_without_any(spark, folder):
    root = folder("gold")
    assert tables.read_gold(spark, root).count() == 0
    empty = spark.createDataFrame([], schemas.GOLD)
    one = spark.createDataFrame([("a",)], "source_file string").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema if f.name != "source_file"])
    sinks.write_gold(one.withColumn("zone", F.lit("standard")), root, "0")
    assert [(r["source_file"], r["zone"], r["batch_id"]) for r in tables.read_gold(spark, root).collect()] == [("a", "standard", "job-0")]


def test_csv_dialect_round_trip(spark, folder, tmp_path):
    """Quotes, commas and backslashes in both directions, and files that Python's reader and writer agree with."""
    import csv
    import glob

    names = ['SARL "LE PAIN", fils', "a\\b", '"', "plain", 'ends with \\"']
    rows = [(f"{i}.pdf", "rib", "1", name, "True", "iban_invalide", "raw_fraud") for i, name in enumerate(names)]
    manifest = spark.createDataFrame(rows, schemas.MANIFEST_CSV)
    path = folder("manifest")
    sinks.write_manifest_csv(manifest, F.col("is_fraud") == "True", path)
    assert {r["company_name"] for r in tables.read_manifest_csv(spark, path).collect()} == set(names)
    read = [row for file in glob.glob(f"{path}/*.csv") for row in csv.DictReader(open(file, encoding="utf-8", newline=""))]
    assert {r["company_name"] for r in read} == set(names) and {r["is_fraud"] for r in read} == {"True"}
    own = tmp_path / "own.csv"
    with own.open("w", encoding="utf-8", newline="") as file:
        writer = csv.writer(file)
        writer.writerows([schemas.MANIFEST_CSV.replace(" string", "").split(", "), *rows])
    assert {(r["company_name"], r["folder"]) for r in tables.read_manifest_csv(spark, str(own)).collect()} == {(n, "raw_fraud") for n in names}


def test_paths_follow_hint_then_label(spark):
    listing = spark.createDataFrame(
        [("raw/s/a.pdf",), ("raw_fraud/s/a.pdf",), ("scans_fraud/s/a.png",), ("raw/s/b.pdf",), ("raw/t/a.pdf",)],
        "path string",
    )
    manifest = spark.createDataFrame(
        [
            (1, "a.pdf", "s", True, ""), (2, "a.pdf", "s", False, None), (3, "a.pdf", "s", True, " RAW "),
            (4, "b.pdf", "s", False, "raw_fraud"), (5, "b.pdf", "s", True, ""), (6, "c.pdf", "s", False, ""),
        ],
        "id int, filename string, company_siret string, fraud boolean, folder string",
    )
    found = paths.resolve_paths(manifest, listing, F.col("fraud"))
    assert {r["id"]: (r["pdf_path"], r["scan_path"]) for r in found.collect()} == {
        1: ("raw_fraud/s/a.pdf", "scans_fraud/s/a.png"),
        2: ("raw/s/a.pdf", "scans_fraud/s/a.png"),
        3: ("raw/s/a.pdf", None),
        4: (None, None),
        5: ("raw/s/b.pdf", None),
        6: (None, None),
    }
    assert {r["id"] for r in paths.unresolved(found).collect()} == {4, 6}


def test_suffix_in_capitals_is_found(spark):
    listing = spark.createDataFrame([("raw/s/B2.PDF",), ("scans/s/B2.png",), ("raw/s/c.pdf",)], "path string")
    manifest = spark.createDataFrame([("B2.PDF", "s", ""), ("b2.pdf", "s", ""), ("c.PDF", "s", "")], "filename string, company_siret string, folder string")
    found = {r["filename"]: (r["pdf_path"], r["scan_path"]) for r in paths.resolve_paths(manifest, listing, F.lit(False)).collect()}
    assert found == {"B2.PDF": ("raw/s/B2.PDF", "scans/s/B2.png"), "b2.pdf": (None, None), "c.PDF": (None, None)}


def test_ground_truth_rows(spark):
    manifest = spark.createDataFrame(
        [
            ("a.pdf", "facture", "11111111111111", "n", "True", " montant_altere ", "raw_fraud"),
            ("b.pdf", "courrier", "11111111111111", "n", "False", None, "raw"),
            ("c.pdf", "rib", "11111111111111", "n", "False", None, "raw"),
        ],
        schemas.MANIFEST_CSV,
    )
    listing = spark.createDataFrame(
        [("raw_fraud/11111111111111/a.pdf",), ("scans_fraud/11111111111111/a.png",)], "path string"
    )
    texts = spark.createDataFrame(
        [("11111111111111", "a.pdf", "SIRET : 22222222222222 Total HT 10,00 € Total TTC 12,00 €")] * 2
        + [("11111111111111", "a.png", "Total HT 99,00 €"), (None, "a.pdf", "x"), ("11111111111111", None, "x")],
        "company_siret string, filename string, text string",
    )
    found = ground_truth.build_ground_truth(manifest, listing, texts, skip_missing=True).collect()
    assert len(found) == 2, "texts of scans and repeated texts make no rows"
    rows = {r["filename"]: r for r in found}
    assert rows.keys() == {"a.pdf", "a.png"}
    for row in rows.values():
        assert (row["is_fraud"], row["fraud_type"], row["siret_doc"], row["montant_ht"], row["montant_ttc"]) == (
            "1", "montant_altere", "22222222222222", "10.00", "12.00",
        )
    assert rows["a.png"]["source_dataset_path"] == "scans_fraud/11111111111111/a.png"
    assert [r["filename"] for r in ground_truth.missing_documents(manifest, listing).collect()] == ["c.pdf"]
    strict = ground_truth.build_ground_truth(manifest, listing, texts)
    for action in (strict.collect, strict.count):
        with pytest.raises(PySparkException, match="missing documents: 11111111111111/c.pdf"):
            action()


def test_invoice_rounding(spark):
    lines = spark.createDataFrame([(1, 3, "0.335"), (1, 1, "10.00")], "invoice_id int, quantite int, pu string").select(
        "invoice_id", "quantite", F.col("pu").cast("decimal(18,3)").alias("prix_unitaire_ht"),
        F.lit("0.055").cast("decimal(4,3)").alias("taux_tva"),
    )
    row = summaries.invoice_totals(lines).collect()[0]
    assert tuple(map(str, row)) == ("1", "11.01", "0.61", "11.62")


def test_company_search_defaults(spark):
    payload = (
        '{"results":[{"siren":"1","siege":{"siret":""}},{"siren":"123456789","siege":{"siret":"S1","numero_voie":"3",'
        '"libelle_voie":"Quai"},"dirigeants":[{"prenom":"A","nom":"B"},{"nom":"C"}]},{"siren":"9","nom_complet":"late",'
        '"siege":{"siret":"S1"}},{"siren":"987654321","siege":{"siret":"S2"},"dirigeants":[]}]}'
    )
    responses = spark.createDataFrame([(1, payload), (2, "{}")], "page int, payload string")
    rows = {r["siret"]: r for r in companies.companies_from_search(responses, "payload", "page", "Personne").collect()}
    assert rows.keys() == {"S1", "S2"}
    first, second = rows["S1"], rows["S2"]
    assert (first["nom"], first["adresse"], first["dirigeant"]) == ("Entreprise Inconnue", "3 Quai", "A B")
    assert (second["adresse"], second["ville"], second["dirigeant"], second["tva_intra"]) == (
        "1 rue de la Paix", "Paris", "Personne", "FR98987654321",
    )
    limited = companies.companies_from_search(responses, "payload", "page", "Personne", stop_at=1)
    assert [r["siret"] for r in limited.collect()] == ["S1"]


def test_backfill_touches_only_files_with_gaps(spark, folder):
    source = folder("gold")

    def gold(name, stamps, score):
        rows = [(f"{name}{i}", score, stamp) for i, stamp in enumerate(stamps)]
        partial = spark.createDataFrame(rows, "source_file string, fraud_score double, gold_imported_at string")
        wanted = spark.createDataFrame([], schemas.GOLD).schema
        return partial.coalesce(1).select(
            *[
                F.col(f.name) if f.name in partial.columns else F.lit(None).cast(f.dataType).alias(f.name)
                for f in wanted
            ]
        )

    gold("full", ["t1", "t2"], 0.9).write.parquet(f"{source}/batch_id=7/zone=high-risk")
    gold("gap", ["t3", None], 0.1).write.parquet(f"{source}/batch_id=7/zone=standard")
    untouched = sorted(os.listdir(f"{source}/batch_id=7/zone=high-risk"))
    summary = maintenance.backfill_imported_at(spark, source).collect()[0]
    assert (summary["scanned"], summary["updated"]) == (2, 1)
    assert sorted(os.listdir(f"{source}/batch_id=7/zone=high-risk")) == untouched
    stamps = {r["source_file"]: r["gold_imported_at"] for r in tables.read_gold(spark, source).collect()}
    assert (stamps["full0"], stamps["full1"]) == ("t1", "t2")
    assert stamps["gap0"] == stamps["gap1"] and stamps["gap0"].endswith("+00:00")
    again = maintenance.backfill_imported_at(spark, source).collect()[0]
    assert (again["scanned"], again["updated"]) == (2, 0)


def test_foreign_ids_meet_on_company_and_name(spark):
    manifest = spark.createDataFrame([("a.pdf", "kbis", "1" * 14), ("a.pdf", "kbis", "2" * 14), ("b.pdf", "rib", "1" * 14)], "filename string, doc_type string, company_siret string")
    shown = f"SIRET (siège) : {'1' * 14}"
    texts = spark.createDataFrame([("1" * 14, "a.pdf", shown), ("2" * 14, "a.pdf", shown), ("1" * 14, "b.pdf", shown)], "company_siret string, filename string, text string")
    found = checks.foreign_siret(texts, manifest).collect()
    assert [(r["company_siret"], r["siret_doc"]) for r in found] == [("2" * 14, "1" * 14)]


def test_bank_details(spark):
    texts = [
        ("IBAN : FR76 3000 4000 1234 5678 9012 143 BIC / SWIFT BNPAFRPP", "FR7630004000123456789012143"),
        ("IBAN FR7630004000123456789012143 TITULAIRE", "FR7630004000123456789012143"),
        ("IBAN DE89 3704 0044 0532 0130 00 BANK", "DE89370400440532013000"),
        ("IBAN XX12 3456 7890 1 SWIFT ABC", "XX12345678901"),
        ("RIB sans numero", None),
    ]
    rows = spark.createDataFrame([(i, "rib", t) for i, (t, _) in enumerate(texts)] + [(9, "kbis", texts[0][0])], "id int, doc_type string, text string")
    found = {r["id"]: r for r in checks.bank_details(rows).collect()}
    assert {i: r["iban"] for i, r in found.items()} == {i: want for i, (_, want) in enumerate(texts)}
    assert found[2]["remainder"] == 1 and found[2]["plausible"] is True
    assert found[4]["remainder"] is None and found[4]["plausible"] is False


def test_sync_pushes_what_it_counts(spark, folder):
    manifest = spark.createDataFrame([("a.pdf", "rib", "1", "n", "False", "", "raw"), ("b.pdf", "rib", "1", "n", "False", "", "raw"), ("c.pdf", "rib", "1", "n", "True", "", "raw_fraud")], schemas.MANIFEST_CSV)
    documents = spark.createDataFrame([("raw/1/a.pdf", b"A"), ("raw_fraud/1/c.pdf", b"C"), ("raw/1/z.pdf", b"Z")], "path string, content binary")
    companies_ = spark.createDataFrame([], schemas.COMPANIES)
    root = folder("bronze")
    summary = maintenance.sync_dataset(manifest, companies_, documents, folder("gold"), root).collect()[0]
    assert summary["pdfs_bronze"] == 1
    assert {r["key"]: bytes(r["content"]) for r in bronze.scan_bronze(spark, root).collect()} == {"raw/1/a.pdf": b"A"}


def test_file_route_uses_the_highest_score(spark):
    rows = spark.createDataFrame(
        [("a", "1", 0.1), ("a", "2", 0.75), ("b", "3", 0.7499)], "source_file string, ocr_text string, fraud_score double"
    )
    zones = {r["ocr_text"]: r["zone"] for r in scoring.route(rows, "now", file="source_file").collect()}
    assert zones == {"1": "high-risk", "2": "high-risk", "3": "standard"}


def test_gold_routing_round_trip(spark, folder, sf_dir):
    from dossierlake.workloads.fixtures import fixture

    root = folder("gold")
    rows = fixture(spark, sf_dir, "fx_gold")
    sinks.write_gold(scoring.route(rows, "2026-01-01T00:00:00+00:00"), root, "0")
    back = tables.read_gold(spark, root)
    assert back.count() == rows.count()
    assert back.where("zone = 'high-risk' AND fraud_score < 0.75 OR zone = 'standard' AND fraud_score >= 0.75").isEmpty()


def test_dashboard_filters_before_sorting_and_counts_all(spark, sf_dir, folder):
    from dossierlake.plans import dashboard
    from dossierlake.workloads.fixtures import fixture

    root = folder("gold")
    gold = scoring.route(fixture(spark, sf_dir, "fx_gold"), "2026-01-01T00:00:00+00:00")
    sinks.write_gold(gold, root, "0", check=True)
    back = tables.read_gold(spark, root)
    items, stats = dashboard.overview(back, "now", wanted="FRAUDE")
    counts = stats.first()
    found = items.collect()
    assert len(found) == counts["fraude"] < counts["total"] == back.count() and {r["status"] for r in found} == {"FRAUDE"}
    dates = [r["createdAt"] for r in found]
    assert dates == sorted(dates, reverse=True)
    assert dashboard.overview(back, "now")[0].count() == counts["total"]


def test_upload_reasons(spark):
    from dossierlake import constants as C
    from dossierlake.functions import files

    rows = spark.createDataFrame([("a.pdf", True), ("b.doc", True), ("c.PNG", False), ("d.doc", False), ("e.pdf", None)], "name string, ok boolean")
    found = {r["name"]: r["reason"] for r in rows.select("name", files.upload_rejection(F.col("name"), F.col("ok")).alias("reason")).collect()}
    assert found == {"a.pdf": None, "b.doc": C.REJECT_REASON, "c.PNG": C.WRITE_REASON, "d.doc": C.REJECT_REASON, "e.pdf": C.WRITE_REASON}


def test_checked_writes(spark, folder):
    root = folder("silver")
    sinks.write_silver(silver_rows(spark, ("a.pdf", "x"), ("a.png", "y")), root, "0", check=True)
    assert tables.read_silver(spark, root).count() == 1


def test_short_account_numbers_do_not_swallow_labels(spark):
    rows = [
        ("IBAN FR76 3000 4000 BIC / SWIFT AGRIFRPP882", "FR7630004000", False),
        ("IBAN FR76 3000 4000 BIC SWIFT AGRIFRPP882 TITULAIRE", "FR7630004000", False),
        ("IBAN : FR76 3000 6000 0112 3456 7890 189 BIC X", "FR7630006000011234567890189", True),
        ("IBAN GB29 NWBK 6016 1331 9268 19 BIC", "GB29NWBK60161331926819", True),
        ("IBAN XX12 3456 BIC", "XX123456", True), ("IBAN inconnu", None, False),
    ]
    found = checks.bank_details(spark.createDataFrame([("rib", r[0]) for r in rows], "doc_type string, text string")).collect()
    assert [(r["iban"], r["plausible"]) for r in found] == [r[1:] for r in rows]


def test_declared_invoices_without_lines_are_found(spark):
    declared = spark.createDataFrame([(1, 12), (2, 50), (3, 0)], "invoice_id int, t int").select("invoice_id", F.col("t").cast("decimal(18,2)").alias("declared_ttc"))
    lines = spark.createDataFrame([(1, 1, 10)], "invoice_id int, quantite int, pu int").select("invoice_id", "quantite", F.col("pu").cast("decimal(18,2)").alias("prix_unitaire_ht"), F.lit("0.20").cast("decimal(4,2)").alias("taux_tva"))
    assert [(r["invoice_id"], r["total_ttc"], float(r["gap"])) for r in checks.altered_amounts(declared, lines).collect()] == [(2, None, 50.0)]


def test_pages_joined_are_the_whole_order(spark, folder):
    """Many rows of one time, of one name and without any; pages read their own files only."""
    times = ["2026-01-02T00:00:00+00:00", "2026-01-02T01:00:00+01:00", "2026-03-01", None, "", "no time"]
    rows = [
        (None if i % 3 == 0 else f"d/{i % 40:02d}.pdf", "e", "facture", "1", float(i), False, "x", 0.1, 0.1, "v", "normal", "VALIDE", "m", 0, times[i % 6 if i % 2 else 0], "standard")
        for i in range(1000)
    ]
    gold, root, now = spark.createDataFrame(rows, schemas.GOLD + ", zone string"), folder("pages"), "2026-02-01T00:00:00+00:00"
    assert paging.page(spark, root, 0, 10, now).count() == 0
    paging.write_pages(gold.limit(5), root, now)
    paging.write_pages(gold.withColumn("extra", F.lit(1)).repartition(7), root, now, per_file=70)
    files = [name for name in os.listdir(f"{root}/rows") if name.endswith(".parquet")]
    assert len(files) == 15 and paging.count_pages(spark, root, 30) == 34

    pages = [paging.page_rows(spark, root, number, 30) for number in range(35)]
    read = [page.collect() for page in pages]
    assert [len(page) for page in read] == [30] * 33 + [10, 0]
    assert max(len(page.inputFiles()) for page in pages) < len(files)
    joined = [row for page in read for row in page]
    created = F.coalesce(F.nullif("gold_imported_at", F.lit("")), F.lit(now))
    key = F.struct(F.coalesce(-F.unix_micros(F.try_to_timestamp(created)), F.lit(0)).alias("t"), F.coalesce("source_file", F.lit("")).alias("f"))
    order = [tuple(row["key"]) for row in spark.createDataFrame(joined, schemas.GOLD).select("amount_total", key.alias("key")).collect()]
    assert order == sorted(order)
    assert sorted(row["amount_total"] for row in joined) == [float(i) for i in range(1000)]
    whole = dashboard.dashboard(gold, now).select("id", "createdAt").collect()
    items = [row for number in range(34) for row in paging.page(spark, root, number, 30, now).select("id", "createdAt").collect()]
    assert sorted(map(str, whole)) == sorted(map(str, items))


def test_empty_pages(spark, folder):
    root = folder("pages")
    paging.write_pages(spark.createDataFrame([], schemas.GOLD), root, "2026-01-01")
    assert paging.count_pages(spark, root, 10) == 0 and paging.page(spark, root, 0, 10, "2026-01-01").count() == 0
    with pytest.raises(ValueError):
        paging.page_rows(spark, root, -1, 10)
