"""Expressions behind the dashboard and the printed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake import constants as C
from dossierlake.functions import doctype
from dossierlake.functions.risk import has_text
from dossierlake.functions.text import blank_to_null, finite, parse_number


def first_filled(
    df: DataFrame, names: list[str], default: Column | None = None, booleans: tuple[str, str] = ("true", "false")
) -> Column:
    """First of the named columns, among those the table has, that is neither null nor empty.

    Whole numbers print without a fraction; ``booleans`` are the texts of true and false.
    """
    types = dict(df.dtypes)
    present = []
    for name in names:
        if name not in types:
            continue
        column = F.col(name)
        if types[name] == "boolean":
            column = F.when(column, booleans[0]).when(~column, booleans[1])
        elif types[name] in ("float", "double"):
            whole = column.try_cast("bigint")
            column = F.when(whole == column, whole.cast("string")).otherwise(column.cast("string"))
        present.append(blank_to_null(column.cast("string")))
    if default is not None:
        present.append(default)
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def created_at(df: DataFrame) -> Column:
    return first_filled(df, C.CREATED_AT_CANDIDATES)


def alerts(doc_type: Column, siret: Column, expired: Column) -> list[Column]:
    """What a user should know about the document: three texts in order, each null when it does not apply."""
    return [
        F.when(expired, C.ALERT_EXPIRED),
        F.when(doc_type == C.UNKNOWN_TYPE, C.ALERT_TYPE),
        F.when(doctype.requires(doc_type, "siret") & ~has_text(siret), C.ALERT_FIELDS),
    ]


def fraud_summary(fraud_score: Column, found: list[Column]) -> Column:
    """At most two alerts behind a prefix chosen by the score."""
    score = F.coalesce(fraud_score, F.lit(0.0))
    first, second, third = found
    both_before = first.isNotNull() & second.isNotNull()
    first_two = F.concat_ws(" ", first, second, F.when(~both_before, third))
    first_one = F.coalesce(*found)
    return (
        F.when(first_one.isNull(), C.SUMMARY_NONE)
        .when(score >= C.HIGH_RISK, F.concat(F.lit(C.SUMMARY_HIGH), first_two))
        .when(score >= C.SUSPECT, F.concat(F.lit(C.SUMMARY_MEDIUM), first_two))
        .otherwise(F.concat(F.lit(C.SUMMARY_LOW), first_one))
    )


def api_status(statut: Column, fraud_score: Column) -> Column:
    flagged = F.upper(F.coalesce(statut, F.lit(""))).isin("FRAUDE", "SUSPECT")
    return F.when(flagged | (F.coalesce(fraud_score, F.lit(0.0)) >= C.HIGH_RISK), "FRAUDE").otherwise("VALIDE")


def dashboard_status(value: Column, boolean: bool = False) -> Column:
    """Status word from free text; a BOOLEAN column reads true as fraud."""
    if boolean:
        return F.when(value, "FRAUDE").otherwise("VALIDE")
    text = F.lower(F.coalesce(value, F.lit("")))
    fraud = text.contains("fraud") | text.contains("anom") | text.contains("ko") | (text == "1")
    return F.when(fraud, "FRAUDE").otherwise("VALIDE")


def dashboard_score(value: Column) -> Column:
    """Number behind the text, zero when there is none."""
    return F.coalesce(finite(parse_number(value.cast("string"))), F.lit(0.0))


def sortable_time(text: Column) -> Column:
    """Microseconds since the epoch; unreadable text sorts as the epoch itself."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(text)), F.lit(0))


def _label(value: Column, labels: dict[str, str], default: str) -> Column:
    pairs = [F.lit(item) for pair in labels.items() for item in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def type_label(value: Column) -> Column:
    return _label(value, C.TYPE_LABELS, C.TYPE_LABELS["AUTRE"])


def status_label(value: Column) -> Column:
    return _label(value, C.STATUS_LABELS, C.UNKNOWN_STATUS_LABEL)


def date_label(text: Column, zone: str = "UTC") -> Column:
    """Day, month, year and time in the given zone; a dash when unreadable."""
    local = F.convert_timezone(None, F.lit(zone), F.try_to_timestamp(text).cast("timestamp_ntz"))
    return F.coalesce(F.date_format(local, "dd/MM/yyyy HH:mm"), F.lit("-"))


def money(value: Column) -> Column:
    """Thousands split by a space, two decimals."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(" "))


def iban_groups(iban: Column) -> Column:
    return F.trim(F.regexp_replace(iban, "(.{4})", "$1 "))


def vat_number(siren: Column, given: Column) -> Column:
    derived = F.concat(F.lit("FR"), F.substring(siren, 1, 2), siren)
    return F.coalesce(blank_to_null(given), derived)


def trade_register(siren: Column, given: Column) -> Column:
    return F.coalesce(blank_to_null(given), F.concat(siren, F.lit(" RCS Paris")))
