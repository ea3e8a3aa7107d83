"""Shapes of the physical plans that matter at scale."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from dossierlake.operators import dedup, pending, summaries
from dossierlake.plans import bronze_silver, ground_truth, scoring, training
from dossierlake.sources import bronze, tables
from dossierlake.workloads import queries
from dossierlake.workloads.fixtures import fixture

# These store objects in Arrow batches while they are planned or run.
LANDING = {"scan_bronze", "scan_packed", "stream_bronze_silver", "sync_summary", "job_pending_silver"}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return queries.trained(spark, sf_dir)


@pytest.fixture
def small_broadcasts_off(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def exchanges(text):
    main = text.split("===== Subqueries =====")[0]
    return [line for line in main.splitlines() if line.strip().startswith("Arguments: hashpartitioning")]


def test_scoring_without_shuffle_while_companies_are_few(spark, sf_dir, model):
    text = plan(scoring.score(fixture(spark, sf_dir, "fx_silver"), model))
    assert exchanges(text) == [] and "Python" not in text and "NestedLoop" not in text
    assert text.split("===== Subqueries =====")[0].count("BroadcastHashJoin LeftOuter") == 2


def test_scoring_shuffles_once_when_companies_are_many(spark, sf_dir, model, small_broadcasts_off):
    """A plain equi-join of two shuffled sides, which adaptive execution can split by size; the bounds are not repeated."""
    text = plan(scoring.score(fixture(spark, sf_dir, "fx_silver"), model))
    assert len(exchanges(text)) == 2 and "Generate" not in text
    assert text.count("SortMergeJoin") and text.count("BroadcastHashJoin LeftOuter") == 1, "the outlook stays broadcast"


def test_ground_truth_shuffles_findings_not_texts(spark, sf_dir, small_broadcasts_off):
    manifest = fixture(spark, sf_dir, "fx_manifest").withColumn("fraud_type", F.lit(""))
    texts = fixture(spark, sf_dir, "fx_text").withColumn("filename", F.concat("doc_id", F.lit(".pdf")))
    listing = fixture(spark, sf_dir, "fx_files")
    text = plan(ground_truth.build_ground_truth(manifest, listing, texts))
    shuffles = exchanges(text)
    assert len(shuffles) == 2, "the manifest, and files folded with findings"
    assert all("hashpartitioning(company_siret" in line and "document" in line for line in shuffles)


def test_extraction_is_one_projection(spark, sf_dir):
    text = plan(bronze_silver.bronze_to_silver(queries._bronze_pages(fixture(spark, sf_dir, "fx_text"))))
    assert "Exchange" not in text and "Python" not in text


def test_zone_filter_prunes_partitions_and_columns(spark, sf_dir, folder):
    from dossierlake.sources import sinks

    root = folder("gold")
    sinks.write_gold(scoring.route(fixture(spark, sf_dir, "fx_gold"), "now"), root, "0")
    text = plan(tables.read_gold(spark, root).where("zone = 'high-risk' AND fraud_score > 0.9").select("source_file"))
    assert "zone" in text.split("PartitionFilters:")[1].splitlines()[0]
    assert "GreaterThan(fraud_score,0.9)" in text
    assert "ReadSchema: struct<source_file:string,fraud_score:double,version:bigint>" in text or "ReadSchema: struct<source_file:string,fraud_score:double>" in text


def test_rejected_suffixes_are_not_opened(spark, folder):
    root = folder("bronze")
    rows = [("a.PdF", b"x"), ("b.docx", b"y"), ("c.jpeg", b"z")]
    bronze.land_objects(spark.createDataFrame(rows, "key string, content binary"), root).collect()
    found = bronze.scan_bronze(spark, root)
    assert sorted(r["key"] for r in found.collect()) == ["a.PdF", "c.jpeg"]
    assert sorted(f.rsplit("/", 1)[1] for f in found.inputFiles()) == ["a.PdF", "c.jpeg"]


def test_listing_reads_no_bytes(spark, folder):
    root = folder("bronze")
    bronze.land_objects(spark.createDataFrame([("a.pdf", b"x")], "key string, content binary"), root).collect()
    assert "content" not in plan(bronze.list_keys(spark, root)).split("ReadSchema:")[1].splitlines()[0]


def test_hot_keys_are_combined_before_the_shuffle(spark, sf_dir):
    uploads = fixture(spark, sf_dir, "fx_uploads")
    assert "partial_min_by" in plan(dedup.dedup_uploads(uploads, ["upload_id"]))
    assert "partial_sum" in plan(summaries.invoice_totals(fixture(spark, sf_dir, "fx_invoice_lines")))
    counted = plan(training.amount_counts(fixture(spark, sf_dir, "fx_ground_truth"), training.LEVELS))
    assert "partial_count" in counted


def test_quantiles_read_their_input_once(spark, sf_dir):
    text = plan(training.amount_bounds(fixture(spark, sf_dir, "fx_ground_truth")))
    assert "amount-counts" in text and "lineitem" not in text and "orders.parquet" not in text


def test_pending_is_an_anti_join_with_top_k(spark, sf_dir):
    text = plan(queries.REGISTRY["pending_bronze"](spark, sf_dir))
    assert "LeftAnti" in text and "Limit" not in text
    keys = fixture(spark, sf_dir, "fx_files").selectExpr("path AS key")
    assert "TakeOrderedAndProject" in plan(pending.pending_bronze(keys, keys, limit=5))


@pytest.mark.parametrize("name", sorted(set(queries.REGISTRY) - LANDING))
def test_no_python_and_no_cartesian_product(name, spark, sf_dir):
    text = plan(queries.REGISTRY[name](spark, sf_dir))
    for word in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in text
