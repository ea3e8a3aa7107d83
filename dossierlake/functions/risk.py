"""Features, rule score, blend and verdict."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, functions as F

from dossierlake import constants as C
from dossierlake.functions import doctype
from dossierlake.functions.text import blank_to_null, finite, parse_number, strip


def resolve_siret(siret: Column, file_name: Column) -> Column:
    """The extracted id, else 14 digits opening the file name, else empty text."""
    from_name = F.regexp_extract(F.coalesce(file_name, F.lit("")), "^" + C.SIRET_PATTERN, 1)
    return F.coalesce(blank_to_null(strip(siret)), from_name)


def amount_band(amount: Column, q_low: Column, q_mid: Column) -> Column:
    value = finite(amount)
    return (
        F.when(value.isNull(), "missing").when(value <= q_low, "low").when(value <= q_mid, "mid").otherwise("high")
    )


def ocr_degraded(engine: Column) -> Column:
    name = F.lower(F.coalesce(engine, F.lit("")))
    return name.contains("fallback") | name.contains("error")


def is_image(file_name: Column) -> Column:
    name = F.lower(F.coalesce(file_name, F.lit("")))
    return reduce(or_, [name.endswith("." + suffix) for suffix in C.IMAGE_SUFFIXES])


def has_text(value: Column) -> Column:
    return F.coalesce(value != "", F.lit(False))


def is_expired(date_text: Column, as_of: Column) -> Column:
    return F.coalesce(date_text.try_cast("date") < as_of, F.lit(False))


def training_features(as_of: Column, q_low: Column, q_mid: Column) -> dict[str, Column]:
    """The seven features of a ground-truth row."""
    amount = parse_number(F.col("montant_ttc"))
    degradation = F.lower(F.coalesce(blank_to_null(F.col("degradation")), F.lit("none")))
    return {
        "doc_type": doctype.normalize(F.col("doc_type"), F.col("filename")),
        "has_siret": has_text(strip(F.col("siret_doc"))),
        "amount_missing": amount.isNull(),
        "mentions_expired": is_expired(F.col("date_expiration"), as_of),
        "ocr_degraded": degradation != "none",
        "is_image": is_image(F.col("filename")),
        "amount_band": amount_band(amount, q_low, q_mid),
    }


def scoring_features(q_low: Column, q_mid: Column) -> dict[str, Column]:
    """The same seven features of a silver row."""
    return {
        "doc_type": doctype.normalize(F.col("document_type"), F.col("source_file")),
        "has_siret": has_text(F.col("siret")),
        "amount_missing": finite(F.col("amount_total")).isNull(),
        "mentions_expired": F.coalesce(F.col("mentions_expired"), F.lit(False)),
        "ocr_degraded": ocr_degraded(F.col("ocr_engine")),
        "is_image": is_image(F.col("source_file")),
        "amount_band": amount_band(F.col("amount_total"), q_low, q_mid),
    }


def feature_value(name: str, value: Column) -> Column:
    """Feature values are counted as text; booleans read True and False."""
    if name in ("doc_type", "amount_band"):
        return value
    return F.when(value, "True").otherwise("False")


def rule_score(
    doc_type: Column,
    siret: Column,
    amount: Column,
    expired: Column,
    degraded: Column,
    type_limit: Column,
    company_low: Column,
    company_high: Column,
) -> Column:
    """Weighted sum of the rules, capped at one. The order of the terms is part of the result."""
    value = finite(amount)
    terms = [
        (expired, C.EXPIRED_WEIGHT),
        (doctype.requires(doc_type, "siret") & ~has_text(siret), C.MISSING_SIRET_WEIGHT),
        (doctype.requires(doc_type, "amount_total") & value.isNull(), C.MISSING_AMOUNT_WEIGHT),
        (doc_type == C.UNKNOWN_TYPE, C.UNKNOWN_TYPE_WEIGHT),
        (degraded, C.OCR_DEGRADED_WEIGHT),
        (value > type_limit, C.ABOVE_TYPE_LIMIT_WEIGHT),
        ((value < company_low) | (value > company_high), C.OUTSIDE_COMPANY_BAND_WEIGHT),
    ]
    total = F.lit(C.BASE_SCORE)
    for test, weight in terms:
        total = total + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return F.least(total, F.lit(1.0))


def blend(ml: Column, rule: Column, type_rate: Column, expired: Column) -> Column:
    """Unrounded final score."""
    mixed = ml * C.ML_SHARE + rule * C.RULE_SHARE + type_rate * C.PRIOR_SHARE
    best = F.greatest(rule, mixed)
    return F.least(F.when(expired, F.greatest(best, F.lit(C.EXPIRED_FLOOR))).otherwise(best), F.lit(1.0))


def issues(doc_type: Column, siret: Column, amount: Column, expired: Column) -> list[Column]:
    """The four possible issue texts in order, each null when it does not apply."""
    value = finite(amount)
    no_amount = doctype.requires(doc_type, "amount_total") & value.isNull()
    return [
        F.when(doctype.requires(doc_type, "siret") & ~has_text(siret), C.ISSUE_SIRET),
        F.when(doc_type == C.UNKNOWN_TYPE, C.ISSUE_TYPE),
        F.when(expired, C.ISSUE_EXPIRED),
        F.when(no_amount, C.ISSUE_NO_AMOUNT).when(value > C.HIGH_AMOUNT, C.ISSUE_HIGH_AMOUNT),
    ]


def issue_text(found: list[Column]) -> Column:
    return F.concat_ws(", ", *found)


def issue_count(found: list[Column]) -> Column:
    return reduce(add, [issue.isNotNull().cast("int") for issue in found])


def verdict(fraud_score: Column, ml_probability: Column, issue_count: Column) -> Column:
    score = F.coalesce(fraud_score, F.lit(0.0))
    ml = F.coalesce(ml_probability, F.lit(0.0))
    return (
        F.when((score >= C.HIGH_RISK) | (ml >= C.ML_FRAUD), "FRAUDE")
        .when((score >= C.SUSPECT) | (issue_count >= 2), "SUSPECT")
        .otherwise("OK")
    )


def ml_flag(fraud_score: Column) -> Column:
    return F.when(fraud_score >= C.HIGH_RISK, 1).otherwise(0)


def risk_level(raw_score: Column) -> Column:
    return F.when(raw_score >= C.HIGH_RISK, "high").otherwise("normal")


def zone(max_rounded_score: Column) -> Column:
    return F.when(max_rounded_score >= C.HIGH_RISK, C.HIGH_RISK_ZONE).otherwise(C.STANDARD_ZONE)
