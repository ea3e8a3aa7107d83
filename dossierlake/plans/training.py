"""Count-based fraud model trained with distributed aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierlake import constants as C, schemas
from dossierlake.functions import doctype, risk
from dossierlake.functions.text import blank_to_null, finite, parse_number
from dossierlake.operators.quantiles import quantiles_from_counts

LEVELS = ["all", "type", "company"]
QUANTILES = {
    "p05": C.COMPANY_LOW_QUANTILE,
    "p33": C.LOW_QUANTILE,
    "p66": C.MID_QUANTILE,
    "p95": C.COMPANY_HIGH_QUANTILE,
}


@dataclass
class FraudModel:
    """The trained tables.

    ``bounds``: level, siret, doc_type, n and the amount quantiles. Level
    ``all`` is one row, ``type`` at most six, ``company`` grows with the data.
    ``counts``: rows per feature, value and label, a few dozen.
    ``outlook``: what the model says of each of the 768 possible vectors.
    """

    bounds: DataFrame
    counts: DataFrame
    outlook: DataFrame


def label(ground_truth: DataFrame) -> Column:
    return ground_truth["is_fraud"].cast("int")


def level_groups() -> dict[str, Column]:
    """The group a row with ``siret``, ``doc_type`` and ``label`` belongs to at each level, or null."""

    def group(level: str, siret: Column, doc_type: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), siret.alias("siret"), doc_type.alias("doc_type"))

    legit = F.col("label") == 0
    blank = F.lit("")
    return {
        "all": group("all", blank, blank),
        "type": F.when(legit, group("type", blank, F.col("doc_type"))),
        "company": F.when(
            legit & F.col("siret").isNotNull(), group("company", F.col("siret"), F.col("doc_type"))
        ),
    }


def amount_counts(ground_truth: DataFrame, levels: list[str]) -> DataFrame:
    """Occurrences of each amount per level: over all rows, and over legitimate rows per type and per company.

    Counting combines map-side, so however many rows a type or a company has,
    only its distinct amounts are shuffled. Numbers too large for a double are
    infinite and count as missing.
    """
    rows = ground_truth.select(
        blank_to_null(F.col("siret_doc")).alias("siret"),
        doctype.normalize(F.col("doc_type"), F.col("filename")).alias("doc_type"),
        label(ground_truth).alias("label"),
        finite(parse_number(F.col("montant_ttc"))).alias("value"),
    ).where(F.col("value").isNotNull())

    groups = level_groups()
    memberships = F.explode(F.array(*[groups[level] for level in levels]))
    return (
        rows.select(memberships.alias("group"), "value")
        .where(F.col("group").isNotNull())
        .groupBy("group.level", "group.siret", "group.doc_type", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def amount_bounds(ground_truth: DataFrame, levels: list[str] | None = None) -> DataFrame:
    """Amount quantiles of each level; a company needs two amounts or more."""
    return bounds_from_counts(amount_counts(ground_truth, levels or LEVELS))


def bounds_from_counts(counts: DataFrame) -> DataFrame:
    """Amount quantiles from occurrences of amounts, in any number of parts."""
    needed = F.when(F.col("level") == "company", C.COMPANY_MIN_AMOUNTS).otherwise(1)
    return quantiles_from_counts(counts, QUANTILES, ["level", "siret", "doc_type"], needed)


def amount_quantiles(bounds: DataFrame) -> DataFrame:
    """The two band limits over all amounts; one row, zeros without any amount."""
    return bounds.where(F.col("level") == "all").agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("n"),
        F.coalesce(F.max("p33"), F.lit(0.0)).alias("q_low"),
        F.coalesce(F.max("p66"), F.lit(0.0)).alias("q_mid"),
    )


def type_bounds(bounds: DataFrame) -> DataFrame:
    """95th percentile of legitimate amounts per type."""
    return bounds.where(F.col("level") == "type").select("doc_type", "p95")


def company_bounds(bounds: DataFrame) -> DataFrame:
    """5th and 95th percentile of legitimate amounts per company and type."""
    return bounds.where(F.col("level") == "company").select(
        "siret", "doc_type", "n", F.col("p05").alias("p5"), "p95"
    )


def feature_vectors(ground_truth: DataFrame, bounds: DataFrame, as_of: str) -> DataFrame:
    """Rows per distinct feature vector and label.

    Seven features and the label have at most 1,536 combinations, so the table
    shrinks map-side and everything counted from it runs on a handful of rows.
    """
    limits = amount_quantiles(bounds).select(F.struct("q_low", "q_mid")).scalar()
    rows = ground_truth.withColumn("limits", limits)
    features = risk.training_features(F.lit(as_of).cast("date"), F.col("limits.q_low"), F.col("limits.q_mid"))
    columns = [risk.feature_value(name, features[name]).alias(name) for name in C.FEATURES]
    return (
        rows.select(*columns, label(rows).alias("label"))
        .groupBy(*C.FEATURES, "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def feature_counts(vectors: DataFrame) -> DataFrame:
    """Rows per (feature, value, label)."""
    long = vectors.unpivot(["label", "n"], C.FEATURES, "feature", "value")
    return long.groupBy("feature", "value", "label").agg(F.sum("n").alias("n"))


def domain_sizes(counts: DataFrame) -> DataFrame:
    """Distinct values per feature, over both labels."""
    return counts.groupBy("feature").agg(F.count_distinct("value").alias("n_values"))


def type_rates(vectors: DataFrame) -> DataFrame:
    """Share of frauds per type, as one exact integer ratio."""
    return vectors.groupBy("doc_type").agg((F.sum(F.col("n") * F.col("label")) / F.sum("n")).alias("rate"))


def train(ground_truth: DataFrame, as_of: str, path: str) -> FraudModel:
    """Train and persist below ``path``; scoring reads the written tables, not the lineage that made them."""
    return fit(ground_truth.sparkSession, path, amount_bounds(ground_truth), lambda bounds: feature_counts(feature_vectors(ground_truth, bounds, as_of)))


def fit(spark: SparkSession, path: str, bounds: DataFrame, counts: Callable[[DataFrame], DataFrame]) -> FraudModel:
    """Persist a model below ``path``: its bounds, what ``counts`` makes of the written bounds, and the outlook of both."""
    bounds.write.mode("overwrite").partitionBy("level").parquet(f"{path}/bounds")
    written = _read(spark, path, "bounds")
    counts(written).write.mode("overwrite").parquet(f"{path}/counts")
    outlook(written, _read(spark, path, "counts")).write.mode("overwrite").parquet(f"{path}/outlook")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> FraudModel:
    return FraudModel(*[_read(spark, path, name) for name in ("bounds", "counts", "outlook")])


def _read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(schemas.MODEL[name]).parquet(f"{path}/{name}")


def bundle(bounds: DataFrame, counts: DataFrame) -> DataFrame:
    """The whole model but the company bounds, as one row of small maps.

    Type and band names are fixed, so the row holds a few dozen values at any
    data size. Each feature has one entry per seen value and one for any
    unseen value, with its counts and smoothed log-likelihoods. Without
    training rows the row is neutral: ``available`` is false, the maps are empty.
    """
    counted = (
        counts.groupBy(F.col("feature").alias("key"), "value")
        .agg(F.expr("sum(if(label = 0, n, 0)) AS n_0"), F.expr("sum(if(label = 1, n, 0)) AS n_1"))
        .selectExpr("'feature' AS kind", "key", "value", "n_0", "n_1")
    )
    limits = bounds.where("level IN ('all', 'type')").selectExpr(
        "level AS kind", "doc_type AS key", "p33", "p66", "p95"
    )
    gathered = [
        "coalesce(sum(if(kind = 'feature' AND key = 'doc_type', n_0, 0)), 0) AS rows_0",
        "coalesce(sum(if(kind = 'feature' AND key = 'doc_type', n_1, 0)), 0) AS rows_1",
        "coalesce(max(if(kind = 'all', p33, NULL)), 0D) AS q_low",
        "coalesce(max(if(kind = 'all', p66, NULL)), 0D) AS q_mid",
        "map_from_entries(collect_list(if(kind = 'type', struct(key, p95), NULL))) AS type_bounds",
    ]
    gathered += [
        f"collect_list(if(kind = 'feature' AND key = '{name}', struct(value, n_0, n_1), NULL)) AS {name}"
        for name in C.FEATURES
    ]
    row = counted.unionByName(limits, allowMissingColumns=True).agg(*map(F.expr, gathered))

    def entry(name: str, n_0: str, n_1: str) -> str:
        return (
            f"named_struct('n_0', {n_0}, 'n_1', {n_1}, "
            f"'log_0', ln(({n_0} + 1) / (rows_0 + size({name}) + 1)), "
            f"'log_1', ln(({n_1} + 1) / (rows_1 + size({name}) + 1)))"
        )

    columns = [
        "rows_0 + rows_1 > 0 AS available",
        f"if(rows_0 + rows_1 > 0, '{C.MODEL_VERSION}', '{C.NEUTRAL_MODEL_VERSION}') AS version",
        "rows_0",
        "rows_1",
        "q_low",
        "q_mid",
        "ln((rows_0 + 1) / (rows_0 + rows_1 + 2)) AS log_prior_0",
        "ln((rows_1 + 1) / (rows_0 + rows_1 + 2)) AS log_prior_1",
        "type_bounds",
        "map_from_entries(transform(doc_type, i -> struct(i.value, i.n_1 / (i.n_0 + i.n_1)))) AS type_rates",
    ]
    for name in C.FEATURES:
        seen = entry(name, "i.n_0", "i.n_1")
        columns.append(f"map_from_entries(transform({name}, i -> struct(i.value, {seen}))) AS weights_{name}")
        columns.append(f"{entry(name, '0L', '0L')} AS unseen_{name}")
    return row.selectExpr(*columns)


def outlook(bounds: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts, posterior, amount limit and fraud rate for every possible feature vector.

    Documents differ only in six types, five flags and four bands, so the
    logarithms are taken once per vector here instead of once per document.
    They are added in the fixed feature order, label by label.
    """
    domains = {name: ["false", "true"] for name in C.FEATURES}
    domains["doc_type"] = [f"'{name}'" for name in [*C.DOC_TYPES, C.UNKNOWN_TYPE]]
    domains["amount_band"] = ["'missing'", "'low'", "'mid'", "'high'"]
    grid = bounds.sparkSession.range(1).select()
    for name in C.FEATURES:
        grid = grid.withColumn(feature_column(name), F.expr(f"explode(array({', '.join(domains[name])}))"))

    found = []
    for name in C.FEATURES:
        text = f"initcap(cast({feature_column(name)} AS string))" if len(domains[name]) == 2 else feature_column(name)
        found.append(f"coalesce(try_element_at(model.weights_{name}, {text}), model.unseen_{name}) AS w_{name}")
    logs = [
        " + ".join([f"model.log_prior_{wanted}", *[f"w_{name}.log_{wanted}" for name in C.FEATURES]])
        for wanted in C.LABELS
    ]
    return (
        grid.withColumn("model", bundle(bounds, counts).select(F.struct("*")).scalar())
        .selectExpr("*", *found)
        .selectExpr("*", *[f"{log} AS log_{wanted}" for wanted, log in zip(C.LABELS, logs)])
        .selectExpr("*", *[f"exp(log_{wanted} - greatest(log_0, log_1)) AS share_{wanted}" for wanted in C.LABELS])
        .selectExpr(
            *[feature_column(name) for name in C.FEATURES],
            *[f"w_{name}.n_{wanted} AS {name}_{wanted}" for name in C.FEATURES for wanted in C.LABELS],
            "if(model.available, share_1 / (share_1 + share_0), 0D) AS ml",
            "try_element_at(model.type_bounds, f_doc_type) AS type_limit",
            f"coalesce(try_element_at(model.type_rates, f_doc_type), {C.DEFAULT_TYPE_RATE}D) AS type_rate",
            "model.version AS model_version",
        )
    )


def feature_column(name: str) -> str:
    """Column of a feature in the outlook; silver tables use some of the bare names."""
    return f"f_{name}"


def neutral(spark: SparkSession) -> FraudModel:
    """The model of an absent ground truth."""
    empty = spark.createDataFrame([], schemas.GROUND_TRUTH)
    bounds = amount_bounds(empty)
    counts = feature_counts(feature_vectors(empty, bounds, "1970-01-01"))
    return FraudModel(bounds, counts, outlook(bounds, counts))
