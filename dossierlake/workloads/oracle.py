"""DuckDB statements giving the expected result of each registered query.

They restate the semantics independently of the engine: joins and window
functions where the engine uses maps, and ``quantile_cont`` where it counts.
"""

from __future__ import annotations

from dossierlake.workloads import fixtures as fx

ORACLE: dict[str, str] = {}
STAMP = fx.AS_OF + "T00:00:00+00:00"

# Whitespace as the engine understands it; \s of this dialect is ASCII only.
SPACE = (
    r"[\s\x{0B}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def sql(name: str, body: str, *ctes: tuple[str, str], use: tuple[str, ...] = ()) -> None:
    parts = [(item, fx.for_duckdb(fx.FIXTURES[item])) for item in use] + list(ctes)
    head = "WITH " + ",\n".join(f"{key} AS ({value})" for key, value in parts) + "\n" if parts else ""
    ORACLE[name] = head + body


def kind(doc_type: str, file_name: str) -> str:
    t, f = f"lower(trim(coalesce({doc_type}, '')))", f"lower(trim(coalesce({file_name}, '')))"
    return f"""CASE WHEN {t} IN ('invoice', 'facture') THEN 'facture' WHEN {t} IN ('quote', 'devis') THEN 'devis'
      WHEN {t} LIKE '%attestation%' OR {t} LIKE '%urssaf%' THEN 'attestation_urssaf'
      WHEN {t} LIKE '%kbis%' THEN 'kbis' WHEN {t} LIKE '%rib%' THEN 'rib'
      WHEN {f} LIKE '%facture%' THEN 'facture' WHEN {f} LIKE '%devis%' THEN 'devis'
      WHEN {f} LIKE '%attestation%' OR {f} LIKE '%urssaf%' THEN 'attestation_urssaf'
      WHEN {f} LIKE '%kbis%' THEN 'kbis' WHEN {f} LIKE '%rib%' THEN 'rib' ELSE 'unknown' END"""


def ui_kind(doc_type: str, file_name: str) -> str:
    t, f = f"lower(coalesce({doc_type}, ''))", f"lower(coalesce({file_name}, ''))"
    return f"""CASE WHEN {t} LIKE '%facture%' OR {t} LIKE '%invoice%' THEN 'FACTURE'
      WHEN {t} LIKE '%devis%' OR {t} LIKE '%quote%' THEN 'DEVIS'
      WHEN {t} LIKE '%urssaf%' OR {t} LIKE '%attestation%' THEN 'ATTESTATION_URSSAF'
      WHEN {t} LIKE '%kbis%' THEN 'KBIS' WHEN {t} LIKE '%rib%' THEN 'RIB'
      WHEN {f} LIKE '%facture%' THEN 'FACTURE' WHEN {f} LIKE '%devis%' THEN 'DEVIS'
      WHEN {f} LIKE '%attestation%' OR {f} LIKE '%urssaf%' THEN 'ATTESTATION_URSSAF'
      WHEN {f} LIKE '%kbis%' THEN 'KBIS' WHEN {f} LIKE '%rib%' THEN 'RIB' ELSE 'AUTRE' END"""


def ui_status(value: str) -> str:
    v = f"lower(coalesce({value}, ''))"
    return f"CASE WHEN {v} LIKE '%fraud%' OR {v} LIKE '%anom%' OR {v} LIKE '%ko%' OR {v} = '1' THEN 'FRAUDE' ELSE 'VALIDE' END"


def truth(test: str) -> str:
    return f"CASE WHEN {test} THEN 'True' ELSE 'False' END"


def stem(key: str) -> str:
    return rf"regexp_replace({key}, '\.[^.]*$', '')"


def collapse(value: str) -> str:
    return f"trim(regexp_replace({value}, '{SPACE}+', ' ', 'g'))"


def strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def found(value: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({value}, '{pattern}', {group}), '')"


def api_status(statut: str = "statut_fraude", score: str = "fraud_score") -> str:
    return (
        f"CASE WHEN upper(coalesce({statut}, '')) IN ('FRAUDE', 'SUSPECT') OR coalesce({score}, 0) >= 0.75 "
        "THEN 'FRAUDE' ELSE 'VALIDE' END"
    )


def url(key: str) -> str:
    return f"concat('/api/v1/documents/view?key=', replace(url_encode({key}), '%2F', '/'))"


SUFFIX = r"\.(pdf|png|jpg|jpeg)$"
UNSUFFIXED = "NOT regexp_matches(lower({0}), '" + SUFFIX + "')"
NEEDS_SIRET = "IN ('facture', 'devis', 'attestation_urssaf', 'kbis')"
NEEDS_AMOUNT = "IN ('facture', 'devis')"

# --- scans and sinks -----------------------------------------------------------

sql(
    "scan_bronze",
    f"""SELECT key, strlen(text) + 2 AS length, {strip('text')} AS text FROM fx_corpus
WHERE regexp_matches(lower(key), '{SUFFIX}')""",
    use=("fx_corpus",),
)

ORACLE["scan_packed"] = ORACLE["scan_bronze"]

SILVER = "source_file, ocr_engine, document_type, siret, amount_total, mentions_expired, ocr_text"
sql("scan_silver", f"SELECT {SILVER} FROM fx_silver", use=("fx_silver",))

REF_DOCS = """SELECT filename, doc_type, company_siret, company_name, is_fraud = 'True' AS is_fraud,
  nullif(CASE WHEN is_fraud = 'True' THEN 'montant_altere' ELSE '' END, NULL) AS fraud_type FROM fx_manifest"""
REF_COMPANIES = """SELECT siren, siret, nom, libelle_voie AS adresse, code_postal, ville, naf, forme_juridique,
  prenom AS dirigeant, concat('FR', substr(siren, 1, 2), siren) AS tva_intra FROM fx_companies"""

sql(
    "scan_gold",
    """SELECT source_file, CASE WHEN fraud_score >= 0.75 THEN 'high-risk' ELSE 'standard' END AS zone, fraud_score,
  statut_fraude, gold_imported_at, NULL AS filename, NULL AS company_siret, siret, NULL AS tva_intra FROM fx_gold
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, filename, company_siret, NULL, NULL FROM ref_docs
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, siret, tva_intra FROM ref_companies""",
    ("ref_docs", REF_DOCS),
    ("ref_companies", REF_COMPANIES),
    use=("fx_gold", "fx_manifest", "fx_companies"),
)
sql("scan_ref_docs", REF_DOCS, use=("fx_manifest",))
sql("scan_ref_companies", REF_COMPANIES, use=("fx_companies",))
sql(
    "scan_manifest_csv",
    """SELECT filename, doc_type, company_siret, company_name, is_fraud, 'montant, altere' AS fraud_type,
  CASE WHEN is_fraud = 'True' THEN 'raw_fraud' ELSE 'raw' END AS folder FROM fx_manifest""",
    use=("fx_manifest",),
)
GROUND_TRUTH = """SELECT filename, doc_type, cast(is_fraud AS varchar) AS is_fraud, nullif(fraud_type, '') AS fraud_type,
  nullif(siret_doc, '') AS siret_doc, nullif(date_expiration, '') AS date_expiration, nullif(montant_ht, '') AS montant_ht,
  nullif(montant_ttc, '') AS montant_ttc, degradation, linked_group_id, concat('raw/', filename) AS source_dataset_path
FROM fx_ground_truth"""
sql("scan_ground_truth", GROUND_TRUTH, use=("fx_ground_truth",))
sql("sink_ground_truth", GROUND_TRUTH, use=("fx_ground_truth",))

COMPANIES = """SELECT siren, siret, coalesce(nom, 'Entreprise Inconnue') AS nom,
  coalesce(nullif(trim(concat_ws(' ', nullif(numero_voie, ''), nullif(type_voie, ''), nullif(libelle_voie, ''))), ''),
    '1 rue de la Paix') AS adresse,
  coalesce(code_postal, '75001') AS code_postal, coalesce(ville, 'Paris') AS ville, coalesce(naf, '62.01Z') AS naf,
  coalesce(forme_juridique, 'SAS') AS forme_juridique{created},
  coalesce(nullif(trim(concat_ws(' ', nullif(prenom, ''), nullif(nom_dirigeant, ''))), ''), 'Sans dirigeant') AS dirigeant,
  concat('FR', substr(siren, 1, 2), siren) AS tva_intra
FROM fx_companies WHERE siret <> '' QUALIFY row_number() OVER (PARTITION BY siret ORDER BY company_no) = 1"""
sql("scan_company_json", COMPANIES.format(created=", '2020-01-01' AS date_creation"), use=("fx_companies",))
sql("sink_companies", COMPANIES.format(created=""), use=("fx_companies",))

sql(
    "sink_silver",
    f"""SELECT * EXCLUDE (stem) FROM (
  SELECT *, {stem('source_file')} AS stem FROM (
    SELECT {SILVER.replace("ocr_text", "CASE WHEN doc_id % 4 = 1 THEN 'later' ELSE ocr_text END AS ocr_text")} FROM fx_silver UNION ALL
    SELECT concat({stem('source_file')}, '.jpg'), ocr_engine, document_type, siret, amount_total, mentions_expired, 'twin'
    FROM fx_silver WHERE doc_id % 4 = 0) u) v
QUALIFY row_number() OVER (PARTITION BY stem ORDER BY source_file) = 1
UNION ALL SELECT concat('new/', source_file), ocr_engine, document_type, siret, amount_total, mentions_expired, ocr_text
FROM fx_silver WHERE doc_id % 4 = 2""",
    use=("fx_silver",),
)
sql(
    "sink_gold_routed",
    f"""SELECT file AS source_file, ocr_text, fraud_score, '{STAMP}' AS gold_imported_at,
  CASE WHEN max(fraud_score) OVER (PARTITION BY file) >= 0.75 THEN 'high-risk' ELSE 'standard' END AS zone
FROM (SELECT * REPLACE (CASE WHEN (doc_id - doc_id % 3) % 2 = 0 THEN round(1 - fraud_score, 4) ELSE fraud_score END AS fraud_score),
  concat('lot_', cast(doc_id - doc_id % 3 AS varchar)) AS file FROM fx_gold) g""",
    use=("fx_gold",),
)
sql(
    "sink_manifest",
    """SELECT filename, doc_type, company_siret, company_name, is_fraud = 'True' AS is_fraud,
  CASE WHEN is_fraud = 'True' THEN 'montant_altere' ELSE '' END AS fraud_type,
  CASE WHEN is_fraud = 'True' THEN 'raw_fraud' ELSE 'raw' END AS folder, is_fraud AS label FROM fx_manifest""",
    use=("fx_manifest",),
)
sql(
    "backfill_imported_at",
    """SELECT CASE WHEN gold_imported_at IS NOT NULL AND doc_id % 2 = 0 THEN 'job-0' ELSE 'job-1' END AS batch_id,
  CASE WHEN fraud_score >= 0.75 THEN 'high-risk' ELSE 'standard' END AS zone, count(*) AS n_rows,
  cast(0 AS bigint) AS n_without_stamp,
  count(*) FILTER (gold_imported_at IS NOT NULL AND doc_id % 2 = 0) AS n_kept, cast(4 AS bigint) AS scanned, cast(2 AS bigint) AS updated
FROM fx_gold GROUP BY 1, 2""",
    use=("fx_gold",),
)
sql(
    "sync_summary",
    """SELECT count(*) AS pdfs_bronze, true AS manifest_gold, true AS companies_gold FROM fx_manifest m
WHERE EXISTS (SELECT 1 FROM fx_files f WHERE f.path = concat('raw/', m.company_siret, '/', m.filename))""",
    use=("fx_manifest", "fx_files"),
)

# --- filters and projections ------------------------------------------------------

REJECTED = UNSUFFIXED.format("name")
sql(
    "upload_triage",
    f"""SELECT upload_id, name, {truth('NOT ' + REJECTED + ' AND size <> 3')} AS accepted,
  CASE WHEN {REJECTED} THEN 'Format rejete - PDF/Image uniquement' WHEN size = 3 THEN 'Erreur d''ecriture MinIO' END AS reason
FROM fx_uploads""",
    use=("fx_uploads",),
)
sql(
    "doc_type_filter",
    "SELECT doc_id, doc_type FROM fx_manifest WHERE doc_type IN ('facture', 'devis', 'attestation_urssaf', 'kbis', 'rib')",
    use=("fx_manifest",),
)
sql(
    "status_filter",
    f"SELECT doc_id, status FROM (SELECT doc_id, {api_status()} AS status FROM fx_gold) g WHERE status = 'FRAUDE'",
    use=("fx_gold",),
)


def bronze_pages(source: str) -> str:
    return f"""SELECT doc_id, text, concat(CASE doc_id % 3 WHEN 0 THEN 'Facture' WHEN 1 THEN 'devis' ELSE 'scan' END, '_',
    cast(doc_id AS varchar),
    CASE WHEN doc_id % 10 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.png' END) AS source_file,
  doc_id % 10 = 0 AS is_text, doc_id % 7 = 0 AS failed FROM {source}"""


ENGINE = """CASE WHEN is_text THEN 'fallback_text_reader' WHEN failed THEN 'fallback_text_reader (ValueError)'
  ELSE 'doctr' END"""
HINTED = """CASE WHEN is_text THEN body ELSE concat(
    CASE WHEN lower(source_file) LIKE '%devis%' AND lower(body) NOT LIKE '%devis%' THEN 'devis ' ELSE '' END,
    CASE WHEN lower(source_file) LIKE '%facture%' AND lower(body) NOT LIKE '%facture%' THEN 'facture ' ELSE '' END,
    body) END"""
AMOUNT = r"""try_cast(replace(replace(regexp_extract({0},
  '(?i)(?:montant|total|ttc)[^\d]{{0,20}}(\d[\d\s]*[.,]\d{{2}})', 1), ' ', ''), ',', '.') AS double)"""
OCR_TYPE = r"""CASE WHEN regexp_matches({0}, '(?i)\b(facture|invoice)\b') THEN 'invoice'
  WHEN regexp_matches({0}, '(?i)\b(devis|quotation|quote)\b') THEN 'quote' ELSE 'unknown' END"""
EXPIRED = r"regexp_matches({0}, '(?i)\b(expire|expired|invalide)\b')"
SIRET = r"(?i)(?:siret\D*)?(\d{14})"


def silver_rows(columns: str) -> str:
    return f"""SELECT {columns}source_file, {ENGINE} AS ocr_engine, {OCR_TYPE.format('clean')} AS document_type,
  {found('clean', SIRET)} AS siret, {AMOUNT.format('clean')} AS amount_total, {EXPIRED.format('clean')} AS mentions_expired,
  hinted AS ocr_text
FROM (SELECT *, {collapse('hinted')} AS clean FROM (SELECT *, {HINTED} AS hinted FROM (
  SELECT *, CASE WHEN is_text OR failed THEN {strip('text')} ELSE text END AS body FROM pages) a) b) c"""


sql("silver_project", silver_rows(""), ("pages", bronze_pages("fx_text")), use=("fx_text",))
sql("job_bronze_silver", silver_rows("doc_id, "), ("pages", bronze_pages("fx_pages")), use=("fx_pages",))

GOLD_KIND = kind("document_type", "source_file")
ALERTS = f"""list_filter([CASE WHEN mentions_expired THEN 'Le document semble expire.' END,
  CASE WHEN {GOLD_KIND} = 'unknown' THEN 'Le type de document n''a pas pu etre confirme automatiquement.' END,
  CASE WHEN {GOLD_KIND} {NEEDS_SIRET} AND coalesce(siret, '') = '' THEN 'Certaines informations obligatoires sont absentes.' END],
  lambda x: x IS NOT NULL)"""
SUMMARY = """CASE WHEN len(alerts) = 0 THEN 'Aucune anomalie detectee.'
  WHEN fraud_score >= 0.75 THEN concat('Controle recommande : ', array_to_string(alerts[1:2], ' '))
  WHEN fraud_score >= 0.45 THEN concat('Points a verifier : ', array_to_string(alerts[1:2], ' '))
  ELSE concat('Information utile : ', alerts[1]) END"""
ALERTED = ("alerted", f"SELECT *, {ALERTS} AS alerts FROM fx_gold")
sql(
    "dashboard_enrich",
    f"""SELECT doc_id, source_file AS filename, {SUMMARY} AS fraud_summary, {api_status()} AS status,
  {url('source_file')} AS preview_url, nullif(gold_imported_at, '') AS "createdAt" FROM alerted""",
    ALERTED,
    use=("fx_gold",),
)
NUMBER = r"""CASE WHEN regexp_matches({0}, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') THEN try_cast({0} AS double) END"""
sql(
    "dashboard_item",
    f"""SELECT cast(doc_id AS varchar) AS id, filename, {ui_kind("coalesce(nullif(doc_type, ''), filename)", 'filename')} AS "docType",
  {ui_status("coalesce(nullif(fraud_status, ''), CASE WHEN is_fraud THEN 'FRAUDE' ELSE 'VALIDE' END)")} AS status,
  coalesce(nullif(reason, ''), 'Aucune alerte') AS reason, coalesce(nullif(created_at, ''), '{STAMP}') AS "createdAt",
  CASE WHEN "previewUrl" <> '' THEN concat('https://api.example.com', "previewUrl") ELSE '' END AS "previewUrl",
  coalesce(nullif(reason, ''), 'Aucune alerte') AS "fraudSummary",
  coalesce({NUMBER.format('coalesce("fraudScore", ' + "'')")}, 0) AS "fraudScore"
FROM (SELECT *, coalesce(nullif(file_name, ''), nullif(nom_document, ''), 'document-inconnu') AS filename FROM fx_records) r""",
    use=("fx_records",),
)
sql(
    "item_defaults",
    f"""SELECT doc_id, cast(doc_id AS varchar) AS id, coalesce(file_name, 'document-inconnu') AS filename,
  coalesce(doc_type, 'AUTRE') AS "docType", coalesce(fraud_status, 'FRAUDE') AS status,
  coalesce(reason, 'Motif indisponible') AS reason, coalesce(created_at, '{STAMP}') AS "createdAt", '' AS "previewUrl",
  coalesce(reason, 'Resume indisponible') AS "fraudSummary",
  CASE WHEN doc_id % 2 = 0 THEN cast(doc_id AS double) / 8 ELSE 0 END AS "fraudScore" FROM fx_records""",
    use=("fx_records",),
)

# --- joins -----------------------------------------------------------------------------

SILVER_KEYS = ("silver_keys", f"SELECT file_id, concat(CASE WHEN file_id % 3 = 1 THEN '' ELSE 'draft/' END, {stem('path')}, '.parquet') AS key FROM fx_files")
sql(
    "pending_bronze",
    f"""SELECT path AS key, concat({stem('path')}, '.parquet') AS silver_key FROM fx_files
WHERE concat({stem('path')}, '.parquet') NOT IN (SELECT key FROM silver_keys) AND regexp_matches(lower(path), '{SUFFIX}')""",
    SILVER_KEYS,
    use=("fx_files",),
)
sql(
    "pending_silver",
    """SELECT key FROM silver_keys s WHERE NOT EXISTS (SELECT 1 FROM gold_keys g
  WHERE g.key IN (concat('standard/', s.key), concat('high-risk/', s.key)))""",
    SILVER_KEYS,
    (
        "gold_keys",
        """SELECT concat(CASE file_id % 4 WHEN 0 THEN 'high-risk/' WHEN 1 THEN 'standard/' ELSE 'other/' END, key) AS key
  FROM silver_keys""",
    ),
    use=("fx_files",),
)
sql(
    "validate_output",
    f"SELECT concat({stem('path')}, '.parquet') AS key FROM fx_files EXCEPT SELECT key FROM silver_keys",
    SILVER_KEYS,
    use=("fx_files",),
)


def resolved(listing: str, manifest: str = "fx_manifest") -> tuple[str, str]:
    def path(folder: str, name: str) -> str:
        return f"(SELECT path FROM {listing} f WHERE f.path = concat('{folder}/', m.company_siret, '/', {name}))"

    def choose(clean: str, fraud: str, name: str) -> str:
        c, f = path(clean, name), path(fraud, name)
        return (
            f"CASE WHEN folder = 'raw_fraud' THEN {f} WHEN folder = 'raw' THEN {c} "
            f"WHEN is_fraud = 'True' THEN coalesce({f}, {c}) ELSE coalesce({c}, {f}) END"
        )

    return (
        "resolved",
        f"""SELECT m.*, {choose('raw', 'raw_fraud', 'm.filename')} AS pdf_path,
  {choose('scans', 'scans_fraud', "replace(lower(m.filename), '.pdf', '.png')")} AS scan_path FROM {manifest} m""",
    )


ODD = ("fx_manifest_odd", "fx_files_odd")
sql("resolve_doc_path", "SELECT doc_id, pdf_path FROM resolved", resolved("fx_files_odd", "fx_manifest_odd"), use=ODD)
sql("resolve_scan_path", "SELECT doc_id, scan_path FROM resolved", resolved("fx_files_odd", "fx_manifest_odd"), use=ODD)

# --- the trained model ----------------------------------------------------------------------

FEATURES = ["doc_type", "has_siret", "amount_missing", "mentions_expired", "ocr_degraded", "is_image", "amount_band"]
IMAGE = r"regexp_matches(lower({0}), '\.(png|jpg|jpeg)$')"


def band(value: str) -> str:
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN 'missing' WHEN {value} <= q_low THEN 'low' WHEN {value} <= q_mid THEN 'mid' ELSE 'high' END"


GT = (
    "gt",
    f"""SELECT doc_id, is_fraud AS label, siret_doc, date_expiration, degradation, filename,
  {kind('doc_type', 'filename')} AS doc_type, try_cast(nullif(montant_ttc, '') AS double) AS ttc FROM fx_ground_truth""",
)
Q = ("q", "SELECT quantile_cont(ttc, 0.33) AS q_low, quantile_cont(ttc, 0.66) AS q_mid, count(ttc) AS n FROM gt")
TF = (
    "tf",
    f"""SELECT doc_id, label, doc_type, {truth("trim(siret_doc) <> ''")} AS has_siret, {truth('ttc IS NULL')} AS amount_missing,
  {truth(f"try_cast(nullif(date_expiration, '') AS date) < DATE '{fx.AS_OF}'")} AS mentions_expired,
  {truth("lower(coalesce(nullif(degradation, ''), 'none')) <> 'none'")} AS ocr_degraded,
  {truth(IMAGE.format('filename'))} AS is_image, {band('ttc')} AS amount_band FROM gt, q""",
)
FC = (
    "fc",
    "SELECT feature, value, label, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT '{name}' AS feature, {name} AS value, label FROM tf" for name in FEATURES)
    + ") u GROUP BY 1, 2, 3",
)
TB = ("tb", "SELECT doc_type, quantile_cont(ttc, 0.95) AS p95 FROM gt WHERE label = 0 AND ttc IS NOT NULL GROUP BY 1")
CB = (
    "cb",
    """SELECT siret_doc AS siret, doc_type, count(ttc) AS n, quantile_cont(ttc, 0.05) AS p5, quantile_cont(ttc, 0.95) AS p95
  FROM gt WHERE label = 0 AND siret_doc <> '' GROUP BY 1, 2 HAVING count(ttc) >= 2""",
)
TR = ("tr", "SELECT doc_type, avg(label) AS rate FROM gt GROUP BY 1")
DEGRADED = "(lower(ocr_engine) LIKE '%fallback%' OR lower(ocr_engine) LIKE '%error%')"
SF = (
    "sf",
    f"""SELECT s.*, {kind('document_type', 'source_file')} AS doc_type, {truth("coalesce(siret, '') <> ''")} AS has_siret,
  {truth('amount_total IS NULL')} AS amount_missing, {truth('mentions_expired')} AS f_expired,
  {truth(DEGRADED)} AS ocr_degraded, {truth(IMAGE.format('source_file'))} AS is_image,
  {band('amount_total')} AS amount_band,
  coalesce(nullif(trim(siret), ''), regexp_extract(source_file, '^(\\d{{14}})', 1)) AS resolved FROM fx_silver s, q""",
)
SCORING = ["doc_type", "has_siret", "amount_missing", "f_expired", "ocr_degraded", "is_image", "amount_band"]
PIVOT = (
    "pv",
    """SELECT feature, value, coalesce(sum(n) FILTER (label = 0), 0) AS n0, coalesce(sum(n) FILTER (label = 1), 0) AS n1
  FROM fc GROUP BY 1, 2""",
)
DOMAIN = ("dm", "SELECT feature, count(DISTINCT value) AS d FROM fc GROUP BY 1")
CLASSES = ("cl", "SELECT count(*) FILTER (label = 0) AS c0, count(*) FILTER (label = 1) AS c1 FROM gt")


def _log(label: int) -> str:
    terms = [f"ln((c{label} + 1.0::double) / (c0 + c1 + 2))"]
    for i, name in enumerate(FEATURES):
        size = f"(SELECT d FROM dm WHERE feature = '{name}')"
        terms.append(f"ln((coalesce(p{i}.n{label}, 0) + 1.0::double) / (c{label} + {size} + 1))")
    return " + ".join(terms)


LOOKUPS = "\n".join(
    f"LEFT JOIN pv p{i} ON p{i}.feature = '{train}' AND p{i}.value = sf.{score}"
    for i, (train, score) in enumerate(zip(FEATURES, SCORING))
)
ML = (
    "ml",
    f"""SELECT doc_id, exp(l1 - greatest(l0, l1)) / (exp(l1 - greatest(l0, l1)) + exp(l0 - greatest(l0, l1))) AS ml FROM (
  SELECT doc_id, {_log(0)} AS l0, {_log(1)} AS l1 FROM sf, cl {LOOKUPS}) x""",
)
RULE = (
    "ru",
    f"""SELECT doc_id, least(1.0::double, 0.05::double + CASE WHEN mentions_expired THEN 0.7::double ELSE 0 END
  + CASE WHEN doc_type {NEEDS_SIRET} AND coalesce(siret, '') = '' THEN 0.25::double ELSE 0 END
  + CASE WHEN doc_type {NEEDS_AMOUNT} AND amount_total IS NULL THEN 0.25::double ELSE 0 END
  + CASE WHEN doc_type = 'unknown' THEN 0.15::double ELSE 0 END + CASE WHEN {DEGRADED} THEN 0.15::double ELSE 0 END
  + CASE WHEN amount_total > type_limit THEN 0.15::double ELSE 0 END
  + CASE WHEN amount_total < lo OR amount_total > hi THEN 0.35::double ELSE 0 END) AS rule
FROM (SELECT sf.*, tb.p95 AS type_limit, cb.p5 AS lo, cb.p95 AS hi FROM sf LEFT JOIN tb ON tb.doc_type = sf.doc_type
  LEFT JOIN cb ON cb.siret = sf.resolved AND cb.doc_type = sf.doc_type) j""",
)
SCORED = (
    "scored",
    """SELECT *, round(raw, 4) AS fraud_score, round(ml, 4) AS ml_probability,
  CASE WHEN raw >= 0.75 THEN 'high' ELSE 'normal' END AS risk_level FROM (
  SELECT sf.*, ml, least(1.0::double, CASE WHEN mentions_expired THEN greatest(b, 0.9::double) ELSE b END) AS raw FROM (
    SELECT doc_id, ml, greatest(rule, ml * 0.45::double + rule * 0.45::double + coalesce(rate, 0.18::double) * 0.1::double) AS b
    FROM ml JOIN ru USING (doc_id) JOIN sf USING (doc_id) LEFT JOIN tr ON tr.doc_type = sf.doc_type) y
  JOIN sf USING (doc_id)) z""",
)
TRAIN = ("fx_ground_truth",)
BOTH = ("fx_ground_truth", "fx_silver")
COUNTED = (GT, Q, TF, FC)
SCORE = (GT, Q, TF, FC, TB, CB, TR, SF, PIVOT, DOMAIN, CLASSES, ML, RULE, SCORED)

sql(
    "company_bounds_lookup",
    """SELECT doc_id, round(p5, 6) AS company_low, round(p95, 6) AS company_high FROM sf
LEFT JOIN cb ON cb.siret = sf.resolved AND cb.doc_type = sf.doc_type""",
    GT, Q, CB, SF, use=BOTH,
)
sql(
    "type_bounds_lookup",
    """SELECT doc_id, sf.doc_type, round(p95, 6) AS type_limit, coalesce(rate, 0.18) AS type_rate FROM sf
LEFT JOIN tb ON tb.doc_type = sf.doc_type LEFT JOIN tr ON tr.doc_type = sf.doc_type""",
    GT, Q, TB, TR, SF, use=BOTH,
)
sql(
    "model_count_lookup",
    "SELECT doc_id, "
    + ", ".join(
        f'cast(coalesce(p{i}.n{label}, 0) AS bigint) AS {name}_{label}' for i, name in enumerate(FEATURES) for label in (0, 1)
    )
    + f" FROM sf {LOOKUPS}",
    *COUNTED, SF, PIVOT, use=BOTH,
)
sql(
    "required_fields_lookup",
    f"""SELECT doc_id, CASE WHEN k {NEEDS_AMOUNT} THEN 'siret,amount_total' WHEN k {NEEDS_SIRET} THEN 'siret' ELSE '' END AS required
FROM (SELECT doc_id, {GOLD_KIND} AS k FROM fx_silver) s""",
    use=("fx_silver",),
)

# --- aggregations ------------------------------------------------------------------------

sql("nb_class_counts", "SELECT is_fraud AS label, count(*) AS n FROM fx_ground_truth GROUP BY 1", use=TRAIN)
sql("nb_feature_counts", "SELECT feature, value, label, n FROM fc", *COUNTED, use=TRAIN)
sql("nb_domain_sizes", "SELECT feature, count(DISTINCT value) AS n_values FROM fc GROUP BY 1", *COUNTED, use=TRAIN)
sql("amount_quantiles", "SELECT n, round(q_low, 6) AS q_low, round(q_mid, 6) AS q_mid FROM q", GT, Q, use=TRAIN)
sql("type_upper_bounds", "SELECT doc_type, round(p95, 6) AS p95 FROM tb", GT, TB, use=TRAIN)
sql("company_bounds", "SELECT siret, doc_type, n, round(p5, 6) AS p5, round(p95, 6) AS p95 FROM cb", GT, CB, use=TRAIN)
sql("type_fraud_rate", "SELECT doc_type, rate FROM tr", GT, TR, use=TRAIN)
TOTALS = (
    "totals",
    """SELECT invoice_id, ht AS total_ht, cast(round(ht * rate, 2) AS decimal(18,2)) AS montant_tva,
  cast(ht + round(ht * rate, 2) AS decimal(18,2)) AS total_ttc FROM (
  SELECT invoice_id, cast(sum(round(quantite * prix_unitaire_ht, 2)) AS decimal(18,2)) AS ht, max(taux_tva) AS rate
  FROM fx_invoice_lines GROUP BY 1) t""",
)
sql(
    "invoice_totals",
    """SELECT invoice_id, cast(total_ht AS double) AS total_ht, cast(montant_tva AS double) AS montant_tva,
  cast(total_ttc AS double) AS total_ttc FROM totals""",
    TOTALS,
    use=("fx_invoice_lines",),
)
STATUS_COUNTS = """SELECT count(*) AS total, count(*) FILTER (status = 'VALIDE') AS valide,
  count(*) FILTER (status = 'FRAUDE') AS fraude FROM (SELECT {0} AS status FROM fx_gold) g"""
sql("dashboard_stats", STATUS_COUNTS.format(api_status()), use=("fx_gold",))
ENVELOPE = "SELECT '{0}' AS endpoint, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'success' END AS status, count(*) AS count, {1} AS message FROM {2}"
EMPTY = "CASE WHEN count(*) = 0 THEN 'Aucune donnee analysee pour le moment' END"
sql(
    "endpoint_envelope",
    " UNION ALL ".join(
        [
            ENVELOPE.format("dashboard", EMPTY, "fx_gold"),
            ENVELOPE.format("documents", "NULL", "fx_manifest"),
            ENVELOPE.format("companies", "NULL", "fx_companies"),
            ENVELOPE.format("nothing", EMPTY, "(SELECT * FROM fx_gold LIMIT 0) none"),
        ]
    ),
    use=("fx_gold", "fx_manifest", "fx_companies"),
)
sql(
    "upload_summary",
    f"""SELECT batch, ok AS successful, ko AS failed,
  CASE WHEN ok = 0 THEN 'error' WHEN ko > 0 THEN 'partial_success' ELSE 'success' END AS status,
  concat(cast(ok AS varchar), ' fichier(s) securise(s), ', cast(ko AS varchar), ' echec(s).') AS message
FROM (SELECT batch, count(*) FILTER (NOT {REJECTED}) AS ok, count(*) FILTER ({REJECTED}) AS ko FROM fx_uploads GROUP BY 1) u""",
    use=("fx_uploads",),
)
sql(
    "dataset_summary",
    """SELECT 'documents' AS section, 'total' AS item, count(*) AS n FROM fx_ground_truth
UNION ALL SELECT 'type', doc_type, count(*) FROM fx_ground_truth GROUP BY doc_type
UNION ALL SELECT 'frauds', 'total', count(*) FROM fx_ground_truth WHERE is_fraud = 1
UNION ALL SELECT 'fraud_type', fraud_type, count(*) FROM fx_ground_truth WHERE is_fraud = 1 GROUP BY fraud_type""",
    use=TRAIN,
)
sql(
    "file_summary",
    """SELECT file, CASE WHEN max(fraud_score) >= 0.75 THEN 'high-risk' ELSE 'standard' END AS zone,
  arg_min(fraud_score, doc_id) AS fraud_score, arg_min(risk_level, doc_id) AS risk_level
FROM (SELECT doc_id - doc_id % 5 AS file, * FROM fx_gold) g GROUP BY 1""",
    use=("fx_gold",),
)
sql(
    "model_bundle",
    "SELECT 'trained' AS name, 'True' AS available, 'ground-truth-naive-bayes-v1' AS version, c0 AS rows_0, c1 AS rows_1, "
    "round(q_low, 6) AS q_low, round(q_mid, 6) AS q_mid, cast((SELECT count(*) FROM tb) AS int) AS n_type_bounds, cast((SELECT count(*) FROM tr) AS int) AS n_type_rates, "
    + ", ".join(f"cast((SELECT d FROM dm WHERE feature = '{name}') AS int) AS n_{name}" for name in FEATURES)
    + " FROM q, cl UNION ALL SELECT 'neutral', 'False', 'rules-only', 0, 0, 0, 0, 0, 0"
    + ", 0" * len(FEATURES),
    *COUNTED, TB, TR, DOMAIN, CLASSES, use=TRAIN,
)

# Training in batches gives what one training on all rows gives.
for whole in ("model_bundle", "company_bounds"):
    ORACLE[f"{whole}_batches"] = ORACLE[whole]

# --- sort, limit, distinct ----------------------------------------------------------------

MICROS = "coalesce(epoch_us(try_cast(gold_imported_at AS timestamptz)), 0)"
sql(
    "sort_created_desc",
    f"SELECT source_file, gold_imported_at, {MICROS} AS sort_key FROM fx_gold ORDER BY sort_key DESC, source_file",
    use=("fx_gold",),
)
sql("topk_pending", "SELECT path AS key FROM fx_files ORDER BY path LIMIT 5", use=("fx_files",))
sql(
    "upload_dedup",
    "SELECT * FROM fx_uploads QUALIFY row_number() OVER (PARTITION BY name, size, last_modified ORDER BY upload_id) = 1",
    use=("fx_uploads",),
)
sql(
    "company_dedup",
    """SELECT company_no, siret, nom, ville FROM fx_companies WHERE siret <> ''
QUALIFY row_number() OVER (PARTITION BY siret ORDER BY company_no) = 1""",
    use=("fx_companies",),
)
sql(
    "stem_collision",
    f"""SELECT concat(stem, '.parquet') AS silver_key, count(*) AS n_sources, min(key) AS kept_key FROM (
  SELECT key, {stem('key')} AS stem FROM (SELECT regexp_replace(path, '^[^/]*/', '') AS key FROM fx_files) f) g
GROUP BY stem HAVING count(*) > 1""",
    use=("fx_files",),
)

# --- set operations --------------------------------------------------------------------------

sql(
    "union_by_name",
    """SELECT doc_id, source_file, siret, amount_total FROM fx_silver
UNION ALL BY NAME SELECT doc_id, filename, siret_doc, montant_ttc FROM fx_ground_truth""",
    use=("fx_silver", "fx_ground_truth"),
)
sql(
    "variant_fanout",
    """SELECT doc_id, filename AS variant_filename, 'none' AS degradation, pdf_path AS source_dataset_path FROM resolved
UNION ALL SELECT doc_id, replace(filename, '.pdf', '.png'), 'scan_degraded', scan_path FROM resolved WHERE scan_path IS NOT NULL""",
    resolved("fx_files"),
    use=("fx_manifest", "fx_files"),
)
sql(
    "file_union",
    "SELECT path, length FROM fx_files WHERE path LIKE 'raw/%' UNION ALL SELECT path, length FROM fx_files WHERE path LIKE 'raw\\_fraud/%' ESCAPE '\\'",
    use=("fx_files",),
)

# --- scalar expressions ------------------------------------------------------------------------

PAGES = ("fx_pages",)
sql("s_lossy_utf8", f"SELECT doc_id, {strip('text')} AS text FROM fx_pages", use=PAGES)
sql("s_engine_tag", f"SELECT doc_id, {ENGINE} AS ocr_engine FROM pages", ("pages", bronze_pages("fx_text")), use=("fx_text",))
sql(
    "s_flatten_words",
    r"""SELECT doc_id, array_to_string(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> ''), ' ') AS words
FROM fx_pages""",
    use=PAGES,
)
sql(
    "s_hint_prefix",
    f"SELECT doc_id, {HINTED} AS text FROM (SELECT *, text AS body FROM pages) p",
    ("pages", bronze_pages("fx_pages")),
    use=PAGES,
)
sql("s_norm_ws", f"SELECT doc_id, {collapse('text')} AS text FROM fx_pages", use=PAGES)
sql("s_siret", f"SELECT doc_id, {found(collapse('text'), SIRET)} AS siret FROM fx_pages", use=PAGES)
sql("s_amount", f"SELECT doc_id, {AMOUNT.format(collapse('text'))} AS amount_total FROM fx_pages", use=PAGES)
sql("s_ocr_type", f"SELECT doc_id, {OCR_TYPE.format('text')} AS document_type FROM fx_pages", use=PAGES)
sql("s_expired", f"SELECT doc_id, {truth(EXPIRED.format('text'))} AS expired FROM fx_pages", use=PAGES)
sql("s_trunc", "SELECT doc_id, substr(text, 1, 5000) AS ocr_text FROM fx_pages", use=PAGES)
sql("s_silver_key", f"SELECT path, concat({stem('path')}, '.parquet') AS silver_key FROM fx_files", use=("fx_files",))
RECORDS = ("fx_records",)
for name, rule in (("s_norm_doc_type", kind), ("s_ui_doc_type", ui_kind)):
    sql(
        name,
        f"SELECT doc_id, {rule('doc_type', 'nom_document')} AS from_declared, {rule('NULL', 'nom_document')} AS from_file FROM fx_records",
        use=RECORDS,
    )
sql(
    "s_ui_status",
    f"SELECT doc_id, {ui_status('fraud_status')} AS from_text, CASE WHEN is_fraud THEN 'FRAUDE' ELSE 'VALIDE' END AS from_boolean FROM fx_records",
    use=RECORDS,
)
sql("s_ui_score", f"""SELECT doc_id, coalesce({NUMBER.format('"fraudScore"')}, 0) AS score FROM fx_records""", use=RECORDS)
sql(
    "s_resolve_siret",
    r"""SELECT doc_id, coalesce(nullif(trim(siret), ''), regexp_extract(source_file, '^(\d{14})', 1)) AS resolved,
  coalesce(nullif(trim(siret), ''), '') AS unnamed FROM fx_silver""",
    use=("fx_silver",),
)
sql(
    "s_amount_band",
    f"""SELECT doc_id, {band('v')} AS band FROM (
  SELECT doc_id, CASE WHEN doc_id % 101 = 0 THEN 'NaN'::double ELSE amount_total END AS v FROM fx_silver) s, q""",
    GT, Q, use=BOTH,
)
sql("s_ocr_degraded", f"SELECT doc_id, {truth(DEGRADED)} AS degraded FROM fx_silver", use=("fx_silver",))
sql("s_train_features", "SELECT doc_id, " + ", ".join(f"{n} AS f_{n}" for n in FEATURES) + " FROM tf", GT, Q, TF, use=TRAIN)
sql(
    "s_score_features",
    "SELECT doc_id, " + ", ".join(f"{s} AS f_{n}" for n, s in zip(FEATURES, SCORING)) + " FROM sf",
    GT, Q, SF, use=BOTH,
)
sql("s_nb_posterior", "SELECT doc_id, round(ml, 4) AS ml_probability FROM ml", *SCORE[:-2], use=BOTH)
sql("s_rule_score", "SELECT doc_id, round(rule, 4) AS rule_score FROM ru", *SCORE[:-1], use=BOTH)
sql("s_blend", "SELECT doc_id, fraud_score, risk_level FROM scored", *SCORE, use=BOTH)


def issue_list(doc_kind: str) -> str:
    return f"""list_filter([CASE WHEN {doc_kind} {NEEDS_SIRET} AND coalesce(siret, '') = '' THEN 'SIRET manquant' END,
  CASE WHEN {doc_kind} = 'unknown' THEN 'Type document inconnu' END, CASE WHEN mentions_expired THEN 'Document expire' END,
  CASE WHEN {doc_kind} {NEEDS_AMOUNT} AND amount_total IS NULL THEN 'Montant manquant'
    WHEN amount_total > 100000 THEN 'Montant suspect eleve' END], lambda x: x IS NOT NULL)"""


STATUT = """CASE WHEN fraud_score >= 0.75 OR ml_probability >= 0.6 THEN 'FRAUDE'
  WHEN fraud_score >= 0.45 OR len(issues) >= 2 THEN 'SUSPECT' ELSE 'OK' END"""
FLAG = "CASE WHEN fraud_score >= 0.75 THEN 1 ELSE 0 END"
ISSUED = ("issued", f"SELECT * EXCLUDE (motif, statut_fraude, ml_flag), {issue_list(GOLD_KIND)} AS issues FROM fx_gold")
GOLD = ("fx_gold",)
sql("s_issues", "SELECT doc_id, array_to_string(issues, ', ') AS motif FROM issued", ISSUED, use=GOLD)
sql("s_statut", f"SELECT doc_id, {STATUT} AS statut FROM issued", ISSUED, use=GOLD)
sql("s_ml_flag", f"SELECT doc_id, {FLAG} AS flag FROM fx_gold", use=GOLD)
sql("s_fraud_summary", f"SELECT doc_id, {SUMMARY} AS summary FROM alerted", ALERTED, use=GOLD)
sql("s_api_status", f"SELECT doc_id, {api_status()} AS status FROM fx_gold", use=GOLD)
sql(
    "s_created_at",
    """SELECT doc_id, coalesce(nullif(gold_imported_at, ''), CASE WHEN doc_id % 2 = 0 THEN '2024-01-02' ELSE '2020-05-05' END) AS created
FROM fx_gold""",
    use=GOLD,
)
QUOTED = url("concat('a b+é~(*)', path)")
sql("s_preview_url", f"SELECT path, {QUOTED} AS url, '' AS blank FROM fx_files", use=("fx_files",))
sql("s_nulls", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN amount_total END AS amount FROM fx_silver", use=("fx_silver",))
sql(
    "s_media_kind",
    f"""SELECT path, CASE WHEN {IMAGE.format('path')} THEN 'image' ELSE 'pdf' END AS kind,
  CASE WHEN lower(path) LIKE '%.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS media_type FROM fx_files""",
    use=("fx_files",),
)
sql(
    "s_labels",
    f"""SELECT doc_id, CASE t WHEN 'FACTURE' THEN 'Facture' WHEN 'DEVIS' THEN 'Devis' WHEN 'ATTESTATION_URSSAF' THEN 'Attestation URSSAF'
    WHEN 'KBIS' THEN 'Extrait Kbis' WHEN 'RIB' THEN 'RIB' ELSE 'Autre' END AS type_label,
  CASE upper(statut_fraude) WHEN 'VALIDE' THEN 'Validé' WHEN 'FRAUDE' THEN 'Fraude' ELSE 'Inconnu' END AS status_label,
  coalesce(strftime(try_cast(replace(gold_imported_at, '+00:00', '') AS timestamp), '%d/%m/%Y %H:%M'), '-') AS date_label
FROM (SELECT *, {ui_kind('document_type', 'source_file')} AS t FROM fx_gold) g""",
    use=GOLD,
)
IS_TRUE = truth("lower(trim(fraud_status)) IN ('1', 'true', 'yes', 'y')")
sql("s_parse_bool", f"SELECT doc_id, {IS_TRUE} AS flag FROM fx_records", use=RECORDS)
sql(
    "s_norm_amount",
    "SELECT doc_id, coalesce(cast(cast(amount_total AS decimal(18,2)) AS varchar), '') AS amount FROM fx_silver",
    use=("fx_silver",),
)
sql(
    "s_norm_date",
    """SELECT doc_id, CASE WHEN length(gold_imported_at) > 10 THEN substr(gold_imported_at, 1, 10) ELSE coalesce(gold_imported_at, '') END AS day
FROM fx_gold""",
    use=GOLD,
)
GT_SIRETS = r"regexp_extract_all({0}, '(?i)SIRET\s*[:\(]?\s*(\d{{14}})', 1)"


def gt_siret(value: str) -> str:
    shown = GT_SIRETS.format(value)
    return f"CASE WHEN list_contains({shown}, company_siret) THEN company_siret ELSE coalesce({shown}[1], company_siret) END"


def gt_amount(word: str) -> str:
    return rf"replace(replace(regexp_extract(text, '(?i)Total {word}\s+([0-9][0-9\s]*[.,][0-9]{{2}})\s*€', 1), ' ', ''), ',', '.')"


VALID = r"regexp_extract(text, 'Du\s+(\d{2}/\d{2}/\d{4})\s+au\s+(\d{2}/\d{2}/\d{4})', 2)"
VALID_END = f"CASE WHEN {VALID} = '' THEN '' ELSE concat(substr({VALID}, 7, 4), '-', substr({VALID}, 4, 2), '-', substr({VALID}, 1, 2)) END"
HEAD_OFFICE = found("text", r"(?i)SIRET\s*\(siège\)\s*:\s*(\d{14})")
KBIS = f"coalesce({HEAD_OFFICE}, {gt_siret('text')})"
TEXT = ("fx_text",)
sql(
    "s_gt_siret",
    f"""SELECT doc_id, {gt_siret('text')} AS siret_doc, {gt_siret("concat('siret (11111111111111) ', text)")} AS siret_of_two FROM fx_text""",
    use=TEXT,
)
sql("s_gt_amounts", f"SELECT doc_id, {gt_amount('HT')} AS montant_ht, {gt_amount('TTC')} AS montant_ttc FROM fx_text", use=TEXT)
sql("s_gt_validity", f"SELECT doc_id, {VALID_END} AS date_expiration FROM fx_text", use=TEXT)
sql("s_gt_kbis", f"SELECT doc_id, {KBIS} AS siret_doc FROM fx_text", use=TEXT)
sql("s_gt_rib", f"SELECT doc_id, {gt_siret('text')} AS siret_doc FROM fx_text", use=TEXT)
DISPATCH = f"""CASE doc_type WHEN 'kbis' THEN {KBIS} WHEN 'courrier' THEN company_siret ELSE {gt_siret('text')} END AS siret_doc,
  CASE WHEN doc_type {NEEDS_AMOUNT} THEN {gt_amount('HT')} ELSE '' END AS montant_ht,
  CASE WHEN doc_type {NEEDS_AMOUNT} THEN {gt_amount('TTC')} ELSE '' END AS montant_ttc,
  CASE WHEN doc_type = 'attestation_urssaf' THEN {VALID_END} ELSE '' END AS date_expiration"""
sql(
    "s_gt_dispatch",
    f"SELECT doc_id, {DISPATCH} FROM (SELECT m.*, text FROM fx_manifest m JOIN fx_text t USING (doc_id)) j",
    use=("fx_manifest", "fx_text"),
)
sql(
    "s_group_id",
    """SELECT doc_id, concat('grp_', company_siret) AS linked_group_id, concat(folder, '/', filename) AS source_dataset_path
FROM fx_manifest""",
    use=("fx_manifest",),
)
sql(
    "s_tva_intra",
    "SELECT company_no, CASE WHEN company_no % 3 = 0 THEN 'FR00123' ELSE concat('FR', substr(siren, 1, 2), siren) END AS tva_intra FROM fx_companies",
    use=("fx_companies",),
)
sql(
    "s_rcs",
    "SELECT company_no, CASE WHEN company_no % 3 = 0 THEN '123 RCS Lyon' ELSE concat(siren, ' RCS Paris') END AS numero_rcs FROM fx_companies",
    use=("fx_companies",),
)
sql("s_fmt_money", "SELECT invoice_id, replace(format('{:,.2f}', cast(prix_unitaire_ht AS double)), ',', ' ') AS price FROM fx_invoice_lines", use=("fx_invoice_lines",))
IBAN = r"nullif(substr(replace(regexp_extract(text, 'IBAN\s*:?\s*([A-Z]{2}[0-9]{2}[0-9A-Z ]*)', 1), ' ', ''), 1, 27), '')"
sql("s_fmt_iban", f"SELECT doc_id, trim(regexp_replace({IBAN}, '(.{{4}})', '\\1 ', 'g')) AS iban FROM fx_text", use=TEXT)

# --- whole jobs ----------------------------------------------------------------------------------

sql(
    "job_score",
    "SELECT doc_id, fraud_score, ml_probability, 'ground-truth-naive-bayes-v1' AS model_version, risk_level FROM scored",
    *SCORE, use=BOTH,
)
sql(
    "job_validate",
    f"SELECT doc_id, {STATUT} AS statut_fraude, array_to_string(issues, ', ') AS motif, {FLAG} AS ml_flag FROM issued",
    ISSUED, use=GOLD,
)
VALIDATED = ("validated", f"SELECT *, {issue_list('doc_type')} AS issues FROM scored")
ZONE = "CASE WHEN fraud_score >= 0.75 THEN 'high-risk' ELSE 'standard' END"
sql(
    "job_silver_gold",
    f"""SELECT source_file, fraud_score, ml_probability, risk_level, {STATUT} AS statut_fraude,
  array_to_string(issues, ', ') AS motif, {FLAG} AS ml_flag, '{STAMP}' AS gold_imported_at, {ZONE} AS zone FROM validated""",
    *SCORE, VALIDATED, use=BOTH,
)
sql(
    "job_ground_truth",
    f"""SELECT v.filename, doc_type, CASE WHEN is_fraud = 'True' THEN '1' ELSE '0' END AS is_fraud,
  CASE WHEN is_fraud = 'True' THEN 'montant_altere' ELSE '' END AS fraud_type, {DISPATCH},
  v.degradation, concat('grp_', company_siret) AS linked_group_id, v.path AS source_dataset_path
FROM (SELECT r.*, text FROM resolved r JOIN fx_text t USING (doc_id)
  WHERE doc_type <> 'courrier' AND pdf_path IS NOT NULL) d
JOIN (SELECT doc_id, filename, 'none' AS degradation, pdf_path AS path FROM resolved UNION ALL
  SELECT doc_id, replace(filename, '.pdf', '.png'), 'scan_degraded', scan_path FROM resolved WHERE scan_path IS NOT NULL) v
  ON v.doc_id = d.doc_id""",
    resolved("fx_files"),
    use=("fx_manifest", "fx_files", "fx_text"),
)
sql(
    "job_dashboard",
    f"""SELECT source_file AS id, source_file AS filename, {ui_kind('document_type', 'source_file')} AS "docType",
  {api_status()} AS status, {SUMMARY} AS reason, coalesce(nullif(gold_imported_at, ''), '{STAMP}') AS "createdAt",
  {url('source_file')} AS "previewUrl", {SUMMARY} AS "fraudSummary", fraud_score AS "fraudScore" FROM alerted""",
    ALERTED, use=GOLD,
)

# All pages together are the whole dashboard.
ORACLE["dashboard_pages"] = ORACLE["job_dashboard"]

# --- streams ------------------------------------------------------------------------------------------

ORACLE["stream_dashboard_stats"] = ORACLE["dashboard_stats"]
sql(
    "stream_bronze_silver",
    silver_rows("").replace("(ValueError)", "(ModuleNotFoundError)"),
    (
        "pages",
        f"""SELECT CASE WHEN twin THEN 'later' ELSE text END AS text, CASE WHEN twin THEN concat({stem('key')}, '.jpeg') ELSE key END AS source_file,
    false AS is_text, true AS failed
  FROM (SELECT *, regexp_matches(lower(key), '\\.(pdf|png)$') AS twin FROM fx_corpus) c WHERE regexp_matches(lower(key), '{SUFFIX}')""",
    ),
    use=("fx_corpus",),
)
sql(
    "job_pending_silver",
    silver_rows("").replace("(ValueError)", "(ModuleNotFoundError)"),
    ("pages", f"SELECT text, key AS source_file, false AS is_text, true AS failed FROM fx_corpus WHERE regexp_matches(lower(key), '{SUFFIX}')"),
    use=("fx_corpus",),
)
sql(
    "stream_silver_gold",
    f"SELECT source_file, fraud_score, {STATUT} AS statut_fraude, {ZONE} AS zone FROM validated",
    *SCORE, VALIDATED, use=BOTH,
)
ORACLE["job_pending_gold"] = ORACLE["stream_silver_gold"]
sql(
    "stream_retry_idempotent",
    f"SELECT {ZONE} AS zone, count(*) AS n_rows, count(DISTINCT source_file) AS n_files FROM scored GROUP BY 1",
    *SCORE, use=BOTH,
)

# --- checks --------------------------------------------------------------------------------------------

sql(
    "check_amount",
    """SELECT invoice_id, cast(total_ttc + extra AS double) AS declared_ttc, cast(total_ttc AS double) AS total_ttc,
  cast(extra AS double) AS gap FROM raised WHERE extra > 0.01 UNION ALL
SELECT -invoice_id, cast(total_ttc + extra AS double), NULL, cast(total_ttc + extra AS double) FROM raised
WHERE invoice_id % 50 = 7 AND total_ttc + extra > 0.01""",
    TOTALS,
    ("raised", "SELECT *, CASE WHEN invoice_id % 19 < 4 THEN 300 + invoice_id % 2701 ELSE 0 END AS extra FROM totals"),
    use=("fx_invoice_lines",),
)
sql(
    "check_expired",
    f"""SELECT doc_id, date_expiration FROM fx_ground_truth
WHERE try_cast(nullif(date_expiration, '') AS date) < DATE '{fx.AS_OF}'""",
    use=TRAIN,
)
sql(
    "check_siret",
    f"""SELECT * FROM (SELECT doc_id, company_siret, {KBIS} AS siret_doc
  FROM (SELECT m.doc_id, m.company_siret, text FROM fx_manifest m JOIN fx_text t USING (doc_id) WHERE doc_type = 'kbis') j) k
WHERE siret_doc <> company_siret""",
    use=("fx_manifest", "fx_text"),
)
sql(
    "check_iban",
    f"""SELECT doc_id, iban, {truth("try_cast(substr(iban, 3, 2) AS int) BETWEEN 2 AND 98")} AS plausible,
  CASE WHEN iban IS NOT NULL THEN cast(cast(concat(substr(iban, 5), '1527', substr(iban, 3, 2)) AS hugeint) % 97 AS int) END AS remainder
FROM (SELECT doc_id, {IBAN} AS iban FROM fx_text WHERE doc_id % 6 = 4) t""",
    use=TEXT,
)
