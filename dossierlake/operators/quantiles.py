"""Exact interpolated quantiles that never gather a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dossierlake.session import scratch_path

# Bits of an amount in cents that the bands of the first two steps leave open; the last step takes single amounts. A step
# orders the bands of one band of the step before: at most 2**15 of them, and in the first some 10**5 for amounts up to 10**12.
STEPS = (30, 15)
# Amounts from here on are banded by their logarithm, so many bands to a doubling, beyond all bands of smaller ones.
LARGE, DOUBLING, BEYOND = 9e13, (8, 23), (1 << 34, 1 << 49)


def exact_amount(value: Column) -> Column:
    """Amounts in whole cents; large ones as they are, since their cents are no longer told apart."""
    return F.when(F.abs(value) < LARGE, F.round(value * 100) / F.lit(100.0)).otherwise(value)


def band_of(amount: Column, step: int) -> Column:
    """Number of the band that holds an amount; it never falls where amounts rise."""
    if step == len(STEPS):
        return amount
    small = F.shiftright(F.round(F.when(F.abs(amount) < LARGE, amount) * 100).cast("long"), STEPS[step])
    doublings = F.floor(F.log2(F.abs(amount)) * (1 << DOUBLING[step])) + BEYOND[step]
    return F.when(F.abs(amount) < LARGE, small).otherwise(F.signum(amount).cast("long") * doublings)


def quantiles_from_counts(
    counts: DataFrame, probabilities: dict[str, float], by: list[str], min_rows: Column | int = 1
) -> DataFrame:
    """Linear-interpolation quantiles per group of ``by``, for amounts of whole cents.

    ``counts`` carries the grouping columns, ``value`` and ``n``, one row per
    distinct value of a group; values are rounded to cents, but for very large
    ones. Values are finite. The counts are written once to the scratch space,
    so what they come from is read once. Counts per band tell
    which bands hold the wanted ranks, and only those are cut into finer bands,
    down to single cents, so what one task orders is bounded however many rows
    a group has. Grouping columns must not be null. Returns the grouping
    columns, ``n`` and one column per probability.
    """

    def position(probability: float) -> Column:
        return F.lit(probability) * (F.col("total") - 1)

    def covers(start: Column, end: Column, rank: Column) -> Column:
        return (start <= rank) & (rank < end)

    wanted = F.lit(False)
    for probability in probabilities.values():
        for rank in (F.floor(position(probability)), F.ceil(position(probability))):
            wanted = wanted | covers(F.col("start"), F.col("end"), rank)

    spark, path = counts.sparkSession, scratch_path(counts.sparkSession, "amount-counts")
    exact = counts.select(*by, exact_amount(F.col("value")).alias("amount"), "n")
    exact.write.parquet(path)
    rows = spark.read.schema(exact.schema).parquet(path)
    group = Window.partitionBy(*by)
    first = rows.groupBy(*by, band_of(F.col("amount"), 0).alias("band")).agg(F.sum("n").alias("n"))
    ranked = (
        first.withColumn("total", F.sum("n").over(group))
        .where(F.col("total") >= min_rows)
        .withColumn("end", F.sum("n").over(group.orderBy("band")))
        .withColumn("start", F.col("end") - F.col("n"))
    )
    for step in range(1, len(STEPS) + 1):
        parents = ranked.where(wanted).select(*by, F.col("band").alias("parent"), F.col("start").alias("base"), "total")
        parent = band_of(F.col("amount"), step - 1).alias("parent")
        finer = rows.groupBy(*by, parent, band_of(F.col("amount"), step).alias("band")).agg(F.sum("n").alias("n"))
        within = Window.partitionBy(*by, "parent").orderBy("band")
        ranked = (
            finer.join(parents, [*by, "parent"])
            .withColumn("end", F.col("base") + F.sum("n").over(within))
            .withColumn("start", F.col("end") - F.col("n"))
        )
    ranked = ranked.withColumnRenamed("band", "value")

    picks = [F.max("total").alias("n")]
    for name, probability in probabilities.items():
        for side, rank in (("lo", F.floor(position(probability))), ("hi", F.ceil(position(probability)))):
            hit = F.when(covers(F.col("start"), F.col("end"), rank), F.col("value"))
            picks.append(F.max(hit).alias(f"{name}_{side}"))
    picked = ranked.groupBy(*by).agg(*picks).withColumn("total", F.col("n"))

    results = []
    for name, probability in probabilities.items():
        share = position(probability) - F.floor(position(probability))
        low, high = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        # Interpolate from the nearer neighbour, so the result never leaves the interval.
        near_low, near_high = low + (high - low) * share, high - (high - low) * (1 - share)
        results.append(F.when(share < 0.5, near_low).otherwise(near_high).alias(name))
    return picked.select(*by, "n", *results)

