"""Declared schemas. Nothing is inferred: ids stay text, amounts stay double."""

from dossierlake.constants import FEATURES, LABELS

BRONZE = "path string, modificationTime timestamp, length bigint, content binary"

#: Objects read from containers.
PACKED = "key string, modificationTime timestamp, length bigint, content binary"

OCR_EXPORT = (
    "struct<pages: array<struct<blocks: array<struct<lines: array<struct<"
    "words: array<struct<value: string>>>>>>>>>"
)

SILVER = (
    "source_file string, ocr_engine string, document_type string, siret string, "
    "amount_total double, mentions_expired boolean, ocr_text string"
)

GOLD = SILVER + (
    ", fraud_score double, ml_probability double, model_version string, risk_level string, "
    "statut_fraude string, motif string, ml_flag int, gold_imported_at string"
)

#: Who wrote a row and when: of rows of one document the highest version counts, of equal ones the highest batch id.
WRITTEN = ", batch_id string, version bigint"

MANIFEST_CSV = (
    "filename string, doc_type string, company_siret string, company_name string, "
    "is_fraud string, fraud_type string, folder string"
)

MANIFEST = (
    "filename string, doc_type string, company_siret string, company_name string, "
    "is_fraud boolean, fraud_type string"
)

COMPANIES = (
    "siren string, siret string, nom string, adresse string, code_postal string, ville string, "
    "naf string, forme_juridique string, dirigeant string, tva_intra string"
)

GROUND_TRUTH = (
    "filename string, doc_type string, is_fraud string, fraud_type string, siret_doc string, "
    "date_expiration string, montant_ht string, montant_ttc string, degradation string, "
    "linked_group_id string, source_dataset_path string"
)

COMPANY_SEARCH = (
    "results array<struct<siren: string, nom_complet: string, activite_principale: string, "
    "nature_juridique: string, date_creation: string, "
    "siege: struct<siret: string, numero_voie: string, type_voie: string, libelle_voie: string, "
    "code_postal: string, libelle_commune: string>, "
    "dirigeants: array<struct<prenom: string, nom: string>>>>"
)

_FLAGS = {name: "string" if name in ("doc_type", "amount_band") else "boolean" for name in FEATURES}

MODEL = {
    "bounds": (
        "siret string, doc_type string, n bigint, p05 double, p33 double, p66 double, p95 double, level string"
    ),
    "counts": "feature string, value string, label int, n bigint",
    "outlook": ", ".join(
        [f"f_{name} {kind}" for name, kind in _FLAGS.items()]
        + [f"{name}_{label} bigint" for name in FEATURES for label in LABELS]
        + ["ml double, type_limit double, type_rate double, model_version string"]
    ),
}

#: What training in batches keeps: occurrences of amounts per level, and of what the features are made of. ``kind`` names the
#: level or the feature.
TRAINING_COUNTS = "kind string, siret string, doc_type string, value string, day date, amount double, label int, n bigint"
