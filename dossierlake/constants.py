"""Fixed values.

Results depend on these exact words, patterns, weights and texts, so they are
kept together here and nowhere else.
"""

# --- document types and the fields each one must carry ---------------------
DOC_TYPES = ["facture", "devis", "attestation_urssaf", "kbis", "rib"]
UNKNOWN_TYPE = "unknown"
REQUIRED_FIELDS = {
    "facture": ["siret", "amount_total"],
    "devis": ["siret", "amount_total"],
    "attestation_urssaf": ["siret"],
    "kbis": ["siret"],
    "rib": [],
    "unknown": [],
}

# --- words by which scoring recognises a type or a file ----------------------
TYPE_NAMES = {"facture": ["invoice", "facture"], "devis": ["quote", "devis"]}
TYPE_WORDS = {"attestation_urssaf": ["attestation", "urssaf"], "kbis": ["kbis"], "rib": ["rib"]}
FILE_WORDS = {
    "facture": ["facture"],
    "devis": ["devis"],
    "attestation_urssaf": ["attestation", "urssaf"],
    "kbis": ["kbis"],
    "rib": ["rib"],
}

# --- words by which the dashboard recognises a type or a file ----------------
DASHBOARD_TYPE_WORDS = {
    "FACTURE": ["facture", "invoice"],
    "DEVIS": ["devis", "quote"],
    "ATTESTATION_URSSAF": ["urssaf", "attestation"],
    "KBIS": ["kbis"],
    "RIB": ["rib"],
}
DASHBOARD_FILE_WORDS = {
    "FACTURE": ["facture"],
    "DEVIS": ["devis"],
    "ATTESTATION_URSSAF": ["attestation", "urssaf"],
    "KBIS": ["kbis"],
    "RIB": ["rib"],
}

# --- naive-Bayes features, in the order their logs are added ----------------
FEATURES = [
    "doc_type",
    "has_siret",
    "amount_missing",
    "mentions_expired",
    "ocr_degraded",
    "is_image",
    "amount_band",
]
LABELS = [0, 1]
MODEL_VERSION = "ground-truth-naive-bayes-v1"
NEUTRAL_MODEL_VERSION = "rules-only"

# --- file suffixes -----------------------------------------------------------
UPLOAD_SUFFIXES = ["pdf", "png", "jpg", "jpeg"]
IMAGE_SUFFIXES = ["png", "jpg", "jpeg"]

# --- text extraction patterns -----------------------------------------------
STORED_TEXT_CHARS = 5000
SIRET_PATTERN = r"(\d{14})"
AMOUNT_PATTERN = r"(?i)(?:montant|total|ttc)[^\d]{0,20}(\d[\d\s]*[.,]\d{2})"
INVOICE_PATTERN = r"(?iU)\b(facture|invoice)\b"
QUOTE_PATTERN = r"(?iU)\b(devis|quotation|quote)\b"
EXPIRED_PATTERN = r"(?iU)\b(expire|expired|invalide)\b"
OCR_ENGINE = "doctr"
FALLBACK_ENGINE = "fallback_text_reader"

# --- ground-truth extraction patterns ----------------------------------------
GT_SIRET_PATTERN = r"(?iU)SIRET\s*[:\(]?\s*([0-9]{14})"
GT_HEAD_OFFICE_PATTERN = r"(?iU)SIRET\s*\(siège\)\s*:\s*([0-9]{14})"
GT_TOTAL_HT_PATTERN = r"(?iU)Total HT\s+([0-9][0-9\s]*[.,][0-9]{2})\s*€"
GT_TOTAL_TTC_PATTERN = r"(?iU)Total TTC\s+([0-9][0-9\s]*[.,][0-9]{2})\s*€"
GT_VALIDITY_PATTERN = r"(?U)Du\s+([0-9]{2}/[0-9]{2}/[0-9]{4})\s+au\s+([0-9]{2}/[0-9]{2}/[0-9]{4})"
GROUND_TRUTH_HEADERS = [
    "filename",
    "doc_type",
    "is_fraud",
    "fraud_type",
    "siret_doc",
    "date_expiration",
    "montant_ht",
    "montant_ttc",
    "degradation",
    "linked_group_id",
    "source_dataset_path",
]
TRUE_WORDS = ["1", "true", "yes", "y"]

# --- rule weights and decision thresholds ------------------------------------
BASE_SCORE = 0.05
EXPIRED_WEIGHT = 0.7
MISSING_SIRET_WEIGHT = 0.25
MISSING_AMOUNT_WEIGHT = 0.25
UNKNOWN_TYPE_WEIGHT = 0.15
OCR_DEGRADED_WEIGHT = 0.15
ABOVE_TYPE_LIMIT_WEIGHT = 0.15
OUTSIDE_COMPANY_BAND_WEIGHT = 0.35
ML_SHARE = 0.45
RULE_SHARE = 0.45
PRIOR_SHARE = 0.10
DEFAULT_TYPE_RATE = 0.18
EXPIRED_FLOOR = 0.9
HIGH_RISK = 0.75
SUSPECT = 0.45
ML_FRAUD = 0.6
HIGH_AMOUNT = 100000
LOW_QUANTILE = 0.33
MID_QUANTILE = 0.66
COMPANY_LOW_QUANTILE = 0.05
COMPANY_HIGH_QUANTILE = 0.95
COMPANY_MIN_AMOUNTS = 2

# Characters of an account number by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "DE": 22, "ES": 24, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "MC": 27, "NL": 18, "PL": 28, "PT": 25,
}

# --- zones and batch size ----------------------------------------------------
HIGH_RISK_ZONE = "high-risk"
STANDARD_ZONE = "standard"
REFERENCE_ZONE = "reference"
BATCH_SIZE = 5

# --- texts shown to users ----------------------------------------------------
ISSUE_SIRET = "SIRET manquant"
ISSUE_TYPE = "Type document inconnu"
ISSUE_EXPIRED = "Document expire"
ISSUE_NO_AMOUNT = "Montant manquant"
ISSUE_HIGH_AMOUNT = "Montant suspect eleve"
ALERT_EXPIRED = "Le document semble expire."
ALERT_TYPE = "Le type de document n'a pas pu etre confirme automatiquement."
ALERT_FIELDS = "Certaines informations obligatoires sont absentes."
SUMMARY_HIGH = "Controle recommande : "
SUMMARY_MEDIUM = "Points a verifier : "
SUMMARY_LOW = "Information utile : "
SUMMARY_NONE = "Aucune anomalie detectee."
REJECT_REASON = "Format rejete - PDF/Image uniquement"
WRITE_REASON = "Erreur d'ecriture MinIO"
EMPTY_MESSAGE = "Aucune donnee analysee pour le moment"
UNKNOWN_FILENAME = "document-inconnu"
PREVIEW_PREFIX = "/api/v1/documents/view?key="
TYPE_LABELS = {
    "FACTURE": "Facture",
    "DEVIS": "Devis",
    "ATTESTATION_URSSAF": "Attestation URSSAF",
    "KBIS": "Extrait Kbis",
    "RIB": "RIB",
    "AUTRE": "Autre",
}
STATUS_LABELS = {"VALIDE": "Validé", "FRAUDE": "Fraude"}
UNKNOWN_STATUS_LABEL = "Inconnu"
DEFAULT_REASON = "Aucune alerte"
ITEM_DEFAULTS = {
    "filename": "document-inconnu",
    "docType": "AUTRE",
    "status": "FRAUDE",
    "reason": "Motif indisponible",
    "previewUrl": "",
    "fraudSummary": "Resume indisponible",
}
DASHBOARD_CANDIDATES = {
    "filename": ["filename", "file_name", "document_name", "nom_document"],
    "docType": ["docType", "document_type", "type", "doc_type"],
    "status": ["status", "statut_fraude", "fraud_status", "is_fraud", "anomaly", "decision", "risk_level"],
    "reason": ["fraud_summary", "reason", "motif", "alert_reason", "anomaly_reason"],
    "createdAt": ["gold_imported_at", "processed_at", "createdAt", "created_at", "timestamp", "date", "date_emission"],
    "previewUrl": ["preview_url", "previewUrl"],
    "fraudScore": ["fraud_score", "fraudScore"],
    "id": ["id", "_id"],
}
CREATED_AT_CANDIDATES = ["gold_imported_at", "processed_at", "createdAt", "created_at", "timestamp", "date"]

# --- company search defaults -------------------------------------------------
COMPANY_DEFAULTS = {
    "nom": "Entreprise Inconnue",
    "adresse": "1 rue de la Paix",
    "code_postal": "75001",
    "ville": "Paris",
    "naf": "62.01Z",
    "forme_juridique": "SAS",
    "date_creation": "2020-01-01",
}
COMPANY_COLUMNS = [
    "siren",
    "siret",
    "nom",
    "adresse",
    "code_postal",
    "ville",
    "naf",
    "forme_juridique",
    "dirigeant",
    "tva_intra",
]
MANIFEST_COLUMNS = ["filename", "doc_type", "company_siret", "company_name", "is_fraud", "fraud_type"]
