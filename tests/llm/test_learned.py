"""Toxicity and quality: grammar, ranking, held-out accuracy, odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake.llm import quality, toxicity
from dossierlake.llm.learning import logistic, remainder, sampled

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 50_000), (5, "You idiot! " * 3000), (6, "nice day"), (6, "nice day"), (None, "You are scum.")]


@pytest.fixture
def scorer():
    return toxicity.Scorer(toxicity.Lexicon())


def total(scorer, text):
    return sum(scorer.clauses(text)[0])


def test_composition_equals_running_the_parts():
    moves, outputs = toxicity.composed(toxicity.GRAMMAR)
    draw = np.random.default_rng(0)
    for _ in range(300):
        state, parts = 0, [p.start for p in toxicity.GRAMMAR]
        for symbol in draw.integers(0, 7, 30).tolist():
            steps = [p.step(s, symbol) for p, s in zip(toxicity.GRAMMAR, parts, strict=True)]
            assert outputs[state][symbol] == pytest.approx(np.prod([w for _, w in steps]))
            state, parts = moves[state][symbol], [s for s, _ in steps]


def test_clauses_not_words(scorer):
    plain = total(scorer, "what an idiot")
    assert total(scorer, "you idiot") > plain > total(scorer, "not an idiot") > 0
    assert plain > total(scorer, "she said idiot") > 0
    assert total(scorer, "not here. an idiot") == plain  # a clause ends what a negation reaches
    assert total(scorer, "not one two three four idiot") == plain
    assert total(scorer, "kill you") < total(scorer, "you kill") <= total(scorer, "you idiot")
    assert len(scorer.clauses("you idiot. fine day. you scum!")[0]) == 2
    assert scorer.clauses("a lovely day")[0] == [] and scorer.features("") == (0.0, 0.0, 0.0, 0.0)


def held_out(done, label, labels):
    rows = done.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return np.array([r["predicted"] for r in rows]), np.array([r[label] for r in rows])


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    done = toxicity.query(spark, sf)
    got, real = held_out(done, "toxic", spark.read.parquet(f"{sf}/labels.parquet"))
    assert (got == real).mean() > 0.97 and got[real == 0].mean() < 0.01 and got[real == 1].mean() > 0.9


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    done = quality.query(spark, sf)
    got, real = held_out(done, "quality", spark.read.parquet(f"{sf}/labels.parquet"))
    assert (got == real).mean() > 0.97 and got[real == 1].mean() > 0.98


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows_and_labels(spark, documents, module, label):
    docs = documents(ODD, score=F.lit("clash"), words=F.lit(0), weight=F.lit("x"), label=F.lit("y"))
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    some = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None), (9, 1)], f"doc_id long, {label} int")
    for labels in (none, some):
        rows = module.scored(docs, module.train(docs, labels), keep=["doc_id"]).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
        again = module.scored(docs, module.train(docs, labels), keep=["doc_id"]).collect()
        assert sorted(map(str, rows)) == sorted(map(str, again))
    assert module.scored(docs.limit(0), module.train(docs, none)).count() == 0


def test_base_list_alone_finds_insults(documents, spark):
    docs = documents(ODD)
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    scores = {r["row"]["doc_id"]: r["score"] for r in toxicity.scored(docs, model).collect()}
    assert scores[5] >= 0.7 > scores[6] and scores[None] > scores[1]


def test_training_reads_no_held_out_label(spark):
    """Flipping held-out labels changes nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        out = remainder(F.col("doc_id"), module.PARTS) == module.HELD_OUT
        flipped = labels.withColumn(label, F.when(out, 1 - F.col(label)).otherwise(F.col(label)))
        a, b = (module.train(docs, x).beta for x in (labels, flipped))
        assert np.allclose(a, b, rtol=1e-9)


def test_remainder_is_crc32(spark):
    import zlib

    rows = spark.range(50).select("id", remainder(F.col("id"), 3).alias("r")).collect()
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 3 for r in rows)


def test_sample_is_bounded(spark):
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    rows = sampled(labels, "toxic", F.lit(True), rows_each=50).collect()
    assert len(rows) == 100 and sum(r["weight"] for r in rows) == pytest.approx(1000)


def test_logistic_recovers_coefficients():
    draw = np.random.default_rng(1)
    x = draw.standard_normal((20000, 2))
    y = (draw.random(20000) < 1 / (1 + np.exp(-(x @ [1.0, -2.0] + 0.5)))).astype(float)
    assert np.allclose(logistic(x, y, np.ones(len(y))), [1.0, -2.0, 0.5], atol=0.1)


def test_pairwise_fit_ranks_and_cuts():
    draw = np.random.default_rng(2)
    label = (draw.random(2000) < 0.8).astype(int)
    x = draw.standard_normal((2000, 3)) + np.outer(label, [3.0, 0.0, -2.0])
    beta = quality.fitted(x, label, np.ones(2000), pairs=5000).beta
    score = 1 / (1 + np.exp(-(x @ beta[:-1] + beta[-1])))
    assert ((score >= 0.3) == (label == 1)).mean() > 0.95
    assert abs((score < 0.3).mean() - (label == 0).mean()) < 0.01


def test_repeated_ids_give_one_labelled_text(spark):
    """However often documents repeat an id, its label comes with one text; a null text is one too."""
    from dossierlake.llm import learning

    docs = spark.range(100_000).selectExpr("id % 2 AS doc_id", "concat('t', id % 7) AS text").unionByName(spark.sql("SELECT 5L AS doc_id, cast(NULL AS string) AS text"))
    rows = spark.createDataFrame([(0, 1, 2.0), (1, 0, 1.0), (5, 0, 1.0), (9, 1, 1.0)], "doc_id long, label int, weight double")
    found = {r["doc_id"]: r for r in learning.with_texts(docs, rows).collect()}
    assert sorted(found) == [0, 1, 5] and found[5]["text"] is None and found[0]["text"].startswith("t") and found[0]["weight"] == 2.0


def test_pairwise_fit_is_of_all_pairs():
    """The strengths minimise the loss over every pair of a good and a bad row, not over drawn ones."""
    draw = np.random.default_rng(4)
    label = (draw.random(400) < 0.7).astype(int)
    x = draw.standard_normal((400, 3)) * [1.0, 5.0, 0.1] + np.outer(label, [1.0, 0.0, -0.1])
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    beta = quality.strengths(lambda b: quality.binned(scaled, label, np.ones(400), b), 3, pairs=10_000)
    gaps = (scaled[label == 1][:, None] - scaled[label == 0][None]).reshape(-1, 3)
    gradient = -(gaps / (1 + np.exp(gaps @ beta))[:, None]).mean(axis=0) + quality.RIDGE / 10_000 * beta
    assert np.abs(gradient).max() < 3e-4 < np.abs(beta).max()


def test_quality_learns_from_every_labelled_row(spark):
    """More rows than any bound on a class: the table gives the model that all rows give in memory; rows that repeat an id count once."""
    words = "CASE WHEN id % 3 = 0 THEN 'FREE || CLICK ## now now now' ELSE concat('the plain text ', id % 11, '.') END"
    docs = spark.range(36_000).selectExpr("id AS doc_id", f"repeat(concat({words}, ' '), cast(1 + id % 5 AS int)) AS text")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 OR doc_id % 50 = 1 THEN 0 ELSE 1 END AS quality")
    used = docs.join(labels, "doc_id").filter(remainder(F.col("doc_id"), quality.PARTS) != quality.HELD_OUT).toPandas()
    x = np.array([quality.features(text) for text in used["text"]])
    assert (used["quality"] == 0).sum() > 8000
    expected = quality.fitted(x, used["quality"].to_numpy(), np.ones(len(x))).beta
    got = quality.train(docs.unionByName(docs.limit(500)), labels).beta
    assert np.allclose(got, expected, rtol=1e-4, atol=1e-4)


def test_value_of_a_rank_is_exact(spark):
    values = [0.1 + k * 1e-17 for k in range(50)] + [5.0] * 30 + list(np.random.default_rng(1).standard_cauchy(500)) + [float(np.nextafter(5, 6))] * 3
    rows = spark.createDataFrame([(float(v),) for v in values], "raw double")
    for rank in (0, 1, 250, 300, 350, len(values) - 2, len(values) - 1):
        assert quality._at_rank(rows, min(values), max(values), rank) == sorted(values)[rank]
