"""The pipeline: each stage against its operator's rule, whole runs on odd tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from dossierlake.llm import bpe, line_dedup, toxicity
from dossierlake.llm.common import stored


def test_stages_over_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    steps = [docs]
    for _, stage in p.STAGES:
        steps.append(stored(stage(spark, steps[-1], sf_dir), "test"))
    for step in steps[:-1]:
        assert step.columns == docs.columns
    rows = [{r["doc_id"]: r for r in step.collect()} for step in steps]
    # Toxic documents that have an insult of the base list go, clean ones stay untouched.
    for i, r in rows[0].items():
        hit = toxicity.Scorer(toxicity.Lexicon()).clauses(r["text"] or "")[0]
        if labels.get(i) == 0:
            assert i in rows[1], i
        if labels.get(i) == 1 and len(hit) > 2:
            assert i not in rows[1], i
    assert all(rows[0][i] == r for i, r in rows[1].items())
    # Lines.
    from tests.llm.test_line_dedup import expected

    want = {i: kept for i, _, _, kept in expected([(i, r["text"]) for i, r in rows[1].items()])}
    assert {i: r["text"] for i, r in rows[2].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2].values())
    # Near duplicates: one of each group.
    from tests.llm.test_near_copies import groups

    ids = sorted(rows[2])
    roots = groups([rows[2][i]["text"] for i in ids])
    assert set(rows[3]) == {ids[r] for r in roots}
    # Mix: rows as they were, at most twice.
    counts = {r["doc_id"]: r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert set(counts) <= set(rows[3]) and max(counts.values()) <= 2 and all(rows[3][i] == r for i, r in rows[4].items())
    # Tokens.
    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert steps[5].count() == steps[4].count()
    for i, r in rows[5].items():
        real = library.encode(rows[4][i]["text"], add_special_tokens=False).ids
        assert bpe.token_ids(r["ids"]) == real and r["ids_sha256"] == hashlib.sha256(np.array(real, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(real, skip_special_tokens=False).encode()).hexdigest()


@pytest.fixture
def tables(spark, folder, documents):
    def make(rows, labels=(), **extra):
        path = folder("tables")
        documents(rows, **extra).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return make


def test_odd_tables(spark, tables):
    rows = [(1, None), (2, ""), (3, ""), (4, "word " * 30_000), (5, "one two three four"), (5, "one two three four"), (None, "no id at all"), (6, "you idiot. you scum. you moron.")]
    path = tables(rows, ids=F.lit("clash"), row=F.lit(1), n_tokens=F.lit("x"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for _, stage in p.STAGES[:-1]:
        docs = stored(stage(spark, docs, path), "odd")
        kept.append(sorted((r["doc_id"] for r in docs.collect()), key=str))
        assert len(docs.columns) == 8
    assert 6 not in kept[0] and kept[0] == kept[1]
    assert kept[2] == sorted([1, 4, 5, None], key=str)  # no words at all is one group
    done = p.tokenise(spark, docs.withColumns({"IDS_sha256": F.lit(1), "decoded_sha256": F.lit(2)}), path)
    assert done.count() == len(kept[3]) and done.columns.count("ids") == 1 and dict(done.dtypes)["ids"] == "binary" and dict(done.dtypes)["n_tokens"] == "bigint"
    assert {"row", "doc_id", "ids_sha256", "decoded_sha256"} <= set(done.columns) and "IDS_sha256" not in done.columns


def test_tokens_take_one_python_worker_a_task(spark, documents):
    """Encoding and decoding after each other would hold two workers for each task at once."""
    done = p.tokenise(spark, documents([(1, "some text"), (2, None)]), "")
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    vocabulary = bpe.share_vocabulary(spark, bpe.vocabulary_path())
    apart = bpe.decode(bpe.encode(documents([(1, "some text"), (2, None)]), vocabulary), vocabulary)
    assert {(r["row"]["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in apart.collect()} == {
        (r["row"]["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode_and_decode(documents([(1, "some text"), (2, None)]), vocabulary).collect()
    }


def test_bytes_that_are_not_utf8(spark, folder):
    """They count as U+FFFD in every stage; the table that goes from stage to stage keeps its rows."""
    path = folder("bytes")
    docs = spark.sql("SELECT id AS doc_id, cast(unhex(concat('616220', h)) AS string) AS text, 'en' AS lang, 's' AS source, 4L AS n_chars FROM VALUES (1L, 'FF'), (2L, 'FE62'), (3L, 'C3') AS t(id, h)")
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    library = Tokenizer.from_file(bpe.vocabulary_path())
    for r in p.run(spark, path).collect():
        assert bpe.token_ids(r["ids"]) in [library.encode(t, add_special_tokens=False).ids for t in ("ab �", "ab �b")]


def test_near_duplicates_go_by_row_not_by_id(spark, documents):
    """Rows without an id, or that share one, are lost only to a near copy."""
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, words(k)) for k in range(6)] + [(7, words(k)) for k in range(10, 14)]
    rows += [(None, words(0)), (7, words(10)), (3, words(11)), (9, words(20)), (None, words(20)), (8, None), (None, ""), (2, "")]
    got = sorted(((r["doc_id"], r["text"]) for r in p.drop_near_duplicates(spark, documents(rows).repartition(3), "").collect()), key=str)
    want = [(None, words(k)) for k in range(6)] + [(7, words(10)), (3, words(11)), (7, words(12)), (7, words(13)), (9, words(20)), (2, "")]
    assert got == sorted(want, key=str)


def test_empty_tables(spark, tables):
    path = tables([])
    done = p.run(spark, path)
    assert done.count() == 0 and {"doc_id", "ids", "n_tokens"} <= set(done.columns)


def test_stages_call_their_operators():
    assert [n for n, _ in p.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "source_mix", "bpe"]
    assert line_dedup and p.ORACLE_SQL is None
