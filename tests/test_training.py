"""Quantiles and the model against brute force on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossierlake import constants as C
from dossierlake.operators.quantiles import quantiles_from_counts
from dossierlake.plans import incremental, scoring, training
from dossierlake.sources import swap, tables

AS_OF = "2026-01-01"
GT = "filename string, doc_type string, is_fraud string, siret_doc string, date_expiration string, montant_ttc string, degradation string"


def test_quantiles_match_numpy_with_a_hot_group(spark):
    rng = random.Random(7)
    rows = [("hot", round(rng.uniform(0, 90000), 2)) for _ in range(3000)] + [("hot", 500.0)] * 1500
    rows += [(f"g{i % 40}", round(rng.lognormvariate(7, 2), 2)) for i in range(400)]
    rows += [("single", 12.5), ("negative", -1500.25), ("negative", 2500.0), ("negative", -0.5)]
    wanted = {"p05": 0.05, "p33": 0.33, "p66": 0.66, "p95": 0.95}
    counts = spark.createDataFrame(rows, "grp string, value double").groupBy("grp", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    found = {row["grp"]: row for row in quantiles_from_counts(counts, wanted, ["grp"]).collect()}
    groups = {}
    for name, amount in rows:
        groups.setdefault(name, []).append(amount)
    assert found.keys() == groups.keys()
    for name, amounts in groups.items():
        assert found[name]["n"] == len(amounts)
        for column, probability in wanted.items():
            assert found[name][column] == pytest.approx(np.quantile(amounts, probability), abs=1e-9)


def test_quantiles_respect_the_minimum(spark):
    counts = spark.createDataFrame([("a", 1.0, 1), ("b", 1.0, 2)], "grp string, value double, n bigint")
    assert [row["grp"] for row in quantiles_from_counts(counts, {"q": 0.5}, ["grp"], 2).collect()] == ["b"]


def _ground_truth(rng, count):
    rows = []
    for i in range(count):
        kind = rng.choice(["facture", "devis", "attestation_urssaf", "kbis", "rib"])
        siret = "01234567890123" if i % 3 == 0 else f"{rng.randrange(20):014d}"
        amount = f"{rng.uniform(10, 5000):.2f}" if kind in ("facture", "devis") and i % 7 else ""
        date = rng.choice(["2020-01-01", "2030-01-01", "pas une date", ""])
        rows.append(
            (
                f"{siret}_{kind}_{i}.{'png' if i % 4 == 0 else 'pdf'}", kind, str(int(rng.random() < 0.3)),
                "" if i % 11 == 0 else siret, date, amount, "none" if i % 5 else "scan_degraded",
            )
        )
    return rows


def _brute_model(rows):
    """The model as dictionaries, one row after the other."""
    amounts = [float(row[5]) for row in rows if row[5]]
    low, mid = np.quantile(amounts, 0.33), np.quantile(amounts, 0.66)

    def band(text):
        if not text:
            return "missing"
        return "low" if float(text) <= low else "mid" if float(text) <= mid else "high"

    classes, seen, per_company = [0, 0], {}, {}
    for name, kind, fraud, siret, date, amount, degradation in rows:
        fraud = int(fraud)
        classes[fraud] += 1
        expired = date[:2] == "20" and date < AS_OF
        vector = (kind, bool(siret), not amount, expired, degradation != "none", name.endswith("png"), band(amount))
        for feature, item in zip(C.FEATURES, vector):
            seen.setdefault(feature, {}).setdefault(item, [0, 0])[fraud] += 1
        if not fraud and siret and amount:
            per_company.setdefault((siret, kind), []).append(float(amount))
    return low, mid, band, classes, seen, per_company


def test_posterior_and_bounds_match_brute_force(spark, folder):
    rows = _ground_truth(random.Random(3), 400)
    low, mid, band, classes, seen, per_company = _brute_model(rows)
    model = training.train(spark.createDataFrame(rows, GT), AS_OF, folder("model"))

    bounds = {(r["siret"], r["doc_type"]): r for r in training.company_bounds(model.bounds).collect()}
    expected = {key: amounts for key, amounts in per_company.items() if len(amounts) >= 2}
    assert bounds.keys() == expected.keys()
    assert any(siret.startswith("0") for siret, _ in bounds)
    for key, amounts in expected.items():
        assert bounds[key]["p5"] == pytest.approx(np.quantile(amounts, 0.05))
        assert bounds[key]["p95"] == pytest.approx(np.quantile(amounts, 0.95))

    outlook = model.outlook.collect()
    assert len(outlook) == 768
    for row in outlook:
        logs = []
        for wanted in (0, 1):
            total = math.log((classes[wanted] + 1) / (sum(classes) + 2))
            for feature in C.FEATURES:
                domain = len(seen[feature])
                count = seen[feature].get(row[f"f_{feature}"], [0, 0])[wanted]
                assert row[f"{feature}_{wanted}"] == count
                total += math.log((count + 1) / (classes[wanted] + domain + 1))
            logs.append(total)
        legit, fraud = (math.exp(value - max(logs)) for value in logs)
        assert row["ml"] == pytest.approx(fraud / (fraud + legit), rel=1e-12)


def test_absent_ground_truth_gives_the_neutral_model(spark):
    silver = spark.createDataFrame(
        [("12345678901234_facture_1.pdf", "doctr", "invoice", None, None, False, "x")],
        "source_file string, ocr_engine string, document_type string, siret string, amount_total double, "
        "mentions_expired boolean, ocr_text string",
    )
    row = scoring.score(silver, training.neutral(spark)).collect()[0]
    assert (row["ml_probability"], row["model_version"]) == (0.0, "rules-only")
    assert row["fraud_score"] == pytest.approx(0.55) and row["risk_level"] == "normal"


def test_what_one_task_orders_is_bounded(spark):
    """Amounts from a cent to a million millions: exact quantiles, and few bands below each band of the step before."""
    import numpy as np

    from dossierlake.operators.quantiles import STEPS, band_of

    draw = np.random.default_rng(5)
    amounts = np.round(np.concatenate([10 ** draw.uniform(-2, 12, 4000), draw.uniform(0, 50, 4000), np.full(3000, 19.99)]), 2)
    values, counts = np.unique(amounts, return_counts=True)
    frame = spark.createDataFrame([("all", float(v), int(n)) for v, n in zip(values, counts, strict=True)], "grp string, value double, n long")
    wanted = {"a": 0.0, "b": 0.05, "c": 0.33, "d": 0.66, "e": 0.95, "f": 1.0}
    row = quantiles_from_counts(frame, wanted, ["grp"]).collect()[0]
    assert row["n"] == len(amounts)
    for name, q in wanted.items():
        assert row[name] == pytest.approx(np.quantile(amounts, q), rel=1e-12, abs=1e-9)
    cents = F.round(F.col("value") * 100).cast("long")
    bands = frame.select(*[band_of(cents, step).alias(f"s{step}") for step in range(len(STEPS))])
    assert bands.select("s0").distinct().count() < 10**5
    for step in range(1, len(STEPS)):
        most = bands.distinct().groupBy(f"s{step - 1}").agg(F.count_distinct(f"s{step}").alias("n")).agg(F.max("n")).first()[0]
        assert most <= 2 ** (STEPS[step - 1] - STEPS[step])


def test_amounts_of_any_size(spark, folder):
    """Very large amounts take their rank; what is too large for a number is missing."""
    rng = random.Random(5)
    amounts = [rng.choice([-1, 1]) * 10 ** rng.uniform(-2, 300) for _ in range(400)] + [1e300, -1e300, 9e13, 9e13 + 1, -9e13, 0.0, -0.01] * 3 + [round(rng.uniform(-50, 50), 2) for _ in range(100)]
    wanted = {f"q{i}": i / 16 for i in range(17)}
    frame = spark.createDataFrame([("g", a) for a in amounts], "grp string, value double").groupBy("grp", "value").agg(F.count(F.lit(1)).alias("n"))
    row = quantiles_from_counts(frame, wanted, ["grp"]).collect()[0]
    exact = [a if abs(a) >= 9e13 else round(a, 2) for a in amounts]
    for name, probability in wanted.items():
        assert row[name] == pytest.approx(np.quantile(exact, probability), rel=1e-9, abs=0.006)
    rows = [(f"{i}_facture.pdf", "facture", "0", "1" * 14, "", text, "none") for i, text in enumerate(["1e300", "1e999", "-1e999", "-250.10", "100", "1e3"])]
    model = training.train(spark.createDataFrame(rows, GT), AS_OF, folder("model"))
    assert training.amount_quantiles(model.bounds).first()["n"] == 4


def _same(left, right):
    """Tables of two models, row by row; sums of logarithms may differ in their last digits."""
    for name in ("bounds", "counts", "outlook"):
        pair = [sorted((tuple(row.asDict().items()) for row in getattr(model, name).collect()), key=str) for model in (left, right)]
        assert len(pair[0]) == len(pair[1]), name
        for one, other in zip(*pair, strict=True):
            for (column, a), (_, b) in zip(one, other, strict=True):
                assert a == (pytest.approx(b, rel=1e-12) if isinstance(b, float) else b), (name, column)


ODD = [
    (None, None, "0", None, None, None, None), ("x.pdf", "facture", "0", "1" * 14, "2020-01-01", "1e999", "none"), ("x.pdf", "facture", "1", " ", "", "1e300", "NONE"),
    ("x.pdf", "facture", "0", "1" * 14, "2020-01-01", "12,5", ""), ("x.pdf", "facture", "0", "1" * 14, "2020-01-01", "-3.005", "none"),
]


def test_batches_equal_one_training(spark, folder):
    """Four batches, with a fold between, a retry of the last and an empty one; then another day."""
    rows, root = _ground_truth(random.Random(9), 300) + ODD * 2, folder("training")
    parts = [rows[:100], rows[100:101], [], rows[101:]]
    for number, part in enumerate(parts):
        incremental.learn(spark.createDataFrame(part, GT), root, str(number))
        if number == 1:
            assert incremental.fold(spark, root) == 2
    incremental.learn(spark.createDataFrame(parts[3], GT), root, "3")
    for day in (AS_OF, "2019-06-01", "2031-01-01"):
        _same(incremental.train(spark, root, day, folder("model")), training.train(spark.createDataFrame(rows, GT), day, folder("model")))
    assert incremental.fold(spark, root) == 2 and incremental.fold(spark, root) == 0
    _same(incremental.train(spark, root, AS_OF, folder("model")), training.train(spark.createDataFrame(rows, GT), AS_OF, folder("model")))
    assert swap.folders(spark, root) == ["batch_id=folded", "folded"]
    with pytest.raises(ValueError, match="folded"):
        incremental.learn(spark.createDataFrame(parts[0], GT), root, "0")


def test_no_batches_give_the_neutral_model(spark, folder):
    _same(incremental.train(spark, folder("training"), AS_OF, folder("model")), training.neutral(spark))


@pytest.mark.parametrize("done", [0, 1, 2, 3])
def test_a_fold_cut_short_is_finished(spark, folder, done, monkeypatch):
    """Whatever step it stops at, the next job ends with every batch counted once."""
    rows, root = _ground_truth(random.Random(2), 60), folder("training")
    for number in range(2):
        incremental.learn(spark.createDataFrame(rows[number::2], GT), root, str(number))
    step, steps = swap.step, []

    def stopping(*arguments):
        if len(steps) == done:
            raise OSError("stopped")
        steps.append(arguments)
        step(*arguments)

    monkeypatch.setattr(swap, "step", stopping)
    with pytest.raises(OSError):
        incremental.fold(spark, root)
    monkeypatch.undo()
    assert swap.recover(spark, root) == (1, 0)
    assert tables.read_training_counts(spark, root).where("kind = 'doc_type'").agg(F.sum("n")).first()[0] == 60
    assert incremental.fold(spark, root) == 0


def test_a_batch_is_counted_in_one_pass(spark, folder):
    rows, path = spark.createDataFrame(_ground_truth(random.Random(2), 20), GT), folder("rows")
    rows.write.parquet(path)
    plan = incremental.batch_counts(spark.read.schema(GT).parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1 and "Python" not in plan
