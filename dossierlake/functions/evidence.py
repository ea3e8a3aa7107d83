"""Fields read from clean document text when labelled ground truth is built."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierlake import constants as C
from dossierlake.functions.text import blank_to_null, strip


def parse_bool(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin(C.TRUE_WORDS), F.lit(False))


def normalize_amount(text: Column) -> Column:
    """Spaces out, comma to dot, null to empty text."""
    compact = F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(strip(compact), F.lit(""))


def normalize_date(text: Column) -> Column:
    """Re-order day/month/year text as year-month-day, without a calendar check."""
    return F.coalesce(F.array_join(F.reverse(F.split(blank_to_null(text), "/")), "-"), F.lit(""))


def sirets_shown(text: Column) -> Column:
    """Every company id printed after its label, in order."""
    return F.regexp_extract_all(text, F.lit(C.GT_SIRET_PATTERN), F.lit(1))


def pick_siret(shown: Column, owner: Column) -> Column:
    """The owner's id when it is shown, else the first id shown, else the owner's."""
    return F.when(F.array_contains(shown, owner), owner).otherwise(F.coalesce(F.get(shown, F.lit(0)), owner))


def siret(text: Column, owner: Column) -> Column:
    return pick_siret(sirets_shown(text), owner)


def head_office_shown(text: Column) -> Column:
    """The id printed for the head office, null without one."""
    return blank_to_null(F.regexp_extract(text, C.GT_HEAD_OFFICE_PATTERN, 1))


def head_office_siret(text: Column, owner: Column) -> Column:
    """The id printed for the head office, else as :func:`siret`."""
    return F.coalesce(head_office_shown(text), siret(text, owner))


def total_ht(text: Column) -> Column:
    return normalize_amount(F.regexp_extract(text, C.GT_TOTAL_HT_PATTERN, 1))


def total_ttc(text: Column) -> Column:
    return normalize_amount(F.regexp_extract(text, C.GT_TOTAL_TTC_PATTERN, 1))


def validity_end(text: Column) -> Column:
    return normalize_date(F.regexp_extract(text, C.GT_VALIDITY_PATTERN, 2))


def findings(text: Column) -> dict[str, Column]:
    """Everything the text alone can tell, a few short values per document."""
    return {
        "shown": sirets_shown(text),
        "head_office": head_office_shown(text),
        "ht": total_ht(text),
        "ttc": total_ttc(text),
        "valid_until": validity_end(text),
    }


def fields_by_type(doc_type: Column, owner: Column, found: dict[str, Column]) -> dict[str, Column]:
    """The output columns: each type uses the findings it prints."""
    picked = pick_siret(found["shown"], owner)
    priced = doc_type.isin("facture", "devis")
    return {
        "siret_doc": F.when(doc_type == "kbis", F.coalesce(found["head_office"], picked))
        .when(doc_type.isin(C.DOC_TYPES), picked)
        .otherwise(owner),
        "montant_ht": F.when(priced, found["ht"]).otherwise(F.lit("")),
        "montant_ttc": F.when(priced, found["ttc"]).otherwise(F.lit("")),
        "date_expiration": F.when(doc_type == "attestation_urssaf", found["valid_until"]).otherwise(F.lit("")),
    }


def group_id(owner: Column) -> Column:
    return F.concat(F.lit("grp_"), owner)
