"""Input projections over the given tables, as SQL that Spark and DuckDB both run.

Table names stand in braces. Spark fills them with DataFrames, DuckDB with view
names, so both sides read the same projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2026-01-01"
TABLES = ["orders", "lineitem", "customer", "nation", "events", "documents"]

FX_SILVER = """
SELECT k AS doc_id,
  concat(sir, '_', dt, '_', lpad(cast(k AS varchar(20)), 6, '0'), CASE WHEN k % 5 = 0 THEN '.png' ELSE '.pdf' END) AS source_file,
  CASE WHEN k % 7 = 0 THEN 'fallback_text_reader (ValueError)' ELSE 'doctr' END AS ocr_engine,
  CASE dt WHEN 'facture' THEN 'invoice' WHEN 'devis' THEN 'quote' ELSE 'unknown' END AS document_type,
  CASE WHEN k % 11 = 0 THEN NULL ELSE sir END AS siret,
  CASE WHEN k % 13 = 0 OR k % 6 > 1 THEN NULL ELSE amt END AS amount_total,
  (k % 17 = 0) AS mentions_expired,
  concat('document ', cast(k AS varchar(20))) AS ocr_text
FROM (
  SELECT o_orderkey AS k, lpad(cast(o_custkey % 200 + 10000000 AS varchar(20)), 14, '8') AS sir, o_totalprice AS amt,
    CASE o_orderkey % 6 WHEN 0 THEN 'facture' WHEN 1 THEN 'devis' WHEN 2 THEN 'attestation_urssaf'
      WHEN 3 THEN 'kbis' WHEN 4 THEN 'rib' ELSE 'courrier' END AS dt
  FROM {orders}) b
"""

FX_GROUND_TRUTH = """
SELECT k AS doc_id,
  concat(sir, '_', dt, '_', lpad(cast(k AS varchar(20)), 6, '0'), CASE WHEN k % 5 = 0 THEN '.png' ELSE '.pdf' END) AS filename,
  dt AS doc_type,
  CASE WHEN k % 19 < 4 OR k % 17 = 0 THEN 1 ELSE 0 END AS is_fraud,
  CASE WHEN k % 19 < 4 OR k % 17 = 0 THEN
    CASE dt WHEN 'facture' THEN 'montant_altere' WHEN 'devis' THEN 'montant_altere'
      WHEN 'attestation_urssaf' THEN 'attestation_expiree' WHEN 'kbis' THEN 'mauvais_siret' ELSE 'iban_invalide' END
    ELSE '' END AS fraud_type,
  CASE WHEN k % 23 = 0 THEN '' ELSE sir END AS siret_doc,
  CASE WHEN dt <> 'attestation_urssaf' THEN '' WHEN k % 17 = 0 THEN '2023-06-30' ELSE '2027-06-30' END AS date_expiration,
  CASE WHEN k % 6 < 2 AND k % 13 <> 0 THEN cast(cast(amt - 1 AS decimal(18,2)) AS varchar(30)) ELSE '' END AS montant_ht,
  CASE WHEN k % 6 < 2 AND k % 13 <> 0 THEN cast(cast(amt AS decimal(18,2)) AS varchar(30)) ELSE '' END AS montant_ttc,
  CASE WHEN k % 5 = 0 THEN 'scan_degraded' ELSE 'none' END AS degradation,
  concat('grp_', sir) AS linked_group_id
FROM (
  SELECT o_orderkey AS k, lpad(cast(o_custkey % 200 + 10000000 AS varchar(20)), 14, '8') AS sir, o_totalprice AS amt,
    CASE o_orderkey % 6 WHEN 0 THEN 'facture' WHEN 1 THEN 'devis' WHEN 2 THEN 'attestation_urssaf'
      WHEN 3 THEN 'kbis' ELSE 'rib' END AS dt
  FROM {orders}) b
"""

FX_TEXT = """
SELECT k AS doc_id, siret AS company_siret,
  CASE k % 6
   WHEN 0 THEN concat('FACTURE N° FAC-', cast(k AS varchar(20)), chr(10), ' SIRET : ', siret, '  Total HT ', cast(ttc - 1 AS varchar(30)), ' €  Total TTC ', replace(cast(ttc AS varchar(30)), '.', ','), ' €')
   WHEN 1 THEN concat('DEVIS ', cast(k AS varchar(20)), ' SIRET : ', siret, ' Total HT ', cast(ttc AS varchar(30)), ' € Total TTC ', substr(cast(ttc AS varchar(30)), 1, length(cast(ttc AS varchar(30))) - 6), ' ', substr(cast(ttc AS varchar(30)), length(cast(ttc AS varchar(30))) - 5, 6), ' €')
   WHEN 2 THEN concat('Attestation de Vigilance SIRET : ', siret, ' Du ', substr(d, 9, 2), '/', substr(d, 6, 2), '/', substr(d, 1, 4), ' au ', substr(d, 9, 2), '/', substr(d, 6, 2), '/', cast(cast(substr(d, 1, 4) AS int) + 1 AS varchar(10)), CASE WHEN k % 17 = 0 THEN ' document expire' ELSE '' END)
   WHEN 3 THEN concat('SIREN : ', substr(siret, 1, 9), ' SIRET (siège) : ', CASE WHEN k % 19 < 4 THEN '99999999999999' ELSE siret END)
   WHEN 4 THEN concat('SIRET : ', siret, ' IBAN ', CASE WHEN k % 5 = 0 THEN 'non communique' ELSE concat(CASE WHEN k % 19 < 4 THEN 'FR99' ELSE 'FR76' END, ' 1710 6000 45', substr(siret, 2, 13)) END, ' BIC / SWIFT AGRIFRPP882 TITULAIRE SARL')
   ELSE 'Courrier sans champ' END AS text
FROM (
  SELECT o_orderkey AS k, lpad(cast(o_custkey % 200 + 10000000 AS varchar(20)), 14, '8') AS siret,
    cast(o_totalprice AS decimal(18,2)) AS ttc, cast(cast(o_orderdate AS date) AS varchar(20)) AS d
  FROM {orders}) b
"""

FX_INVOICE_LINES = """
SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, cast(l_quantity AS int) AS quantite,
  cast(l_extendedprice AS decimal(18,2)) AS prix_unitaire_ht,
  CASE l_orderkey % 3 WHEN 0 THEN cast(0.055 AS decimal(4,3)) WHEN 1 THEN cast(0.10 AS decimal(4,3))
    ELSE cast(0.20 AS decimal(4,3)) END AS taux_tva
FROM {lineitem}
"""

FX_MANIFEST = """
SELECT k AS doc_id, concat(sir, '_', dt, '_', lpad(cast(k AS varchar(20)), 6, '0'), '.pdf') AS filename, dt AS doc_type,
  sir AS company_siret, CASE WHEN k % 7 = 0 THEN concat('SARL "LE PAIN ', cast(co AS varchar(20)), '", fils') ELSE concat('Customer#', cast(co AS varchar(20))) END AS company_name,
  CASE WHEN k % 19 < 4 THEN 'True' ELSE 'False' END AS is_fraud,
  CASE WHEN k % 29 = 0 THEN '' WHEN k % 19 < 4 THEN 'raw_fraud' ELSE 'raw' END AS folder
FROM (
  SELECT o_orderkey AS k, o_custkey % 200 AS co, lpad(cast(o_custkey % 200 + 10000000 AS varchar(20)), 14, '8') AS sir,
    CASE o_orderkey % 6 WHEN 0 THEN 'facture' WHEN 1 THEN 'devis' WHEN 2 THEN 'attestation_urssaf'
      WHEN 3 THEN 'kbis' WHEN 4 THEN 'rib' ELSE 'courrier' END AS dt
  FROM {orders}) b
"""

FX_FILES = """
SELECT k AS file_id, concat(zone, '/', sir, '/', sir, '_', dt, '_', lpad(cast(k AS varchar(20)), 6, '0'), ext) AS path, k * 10 AS length
FROM (
  SELECT o_orderkey AS k, lpad(cast(o_custkey % 200 + 10000000 AS varchar(20)), 14, '8') AS sir,
    CASE WHEN o_orderkey % 19 < 4 THEN 'raw_fraud' ELSE 'raw' END AS zone, '.pdf' AS ext,
    CASE o_orderkey % 6 WHEN 0 THEN 'facture' WHEN 1 THEN 'devis' WHEN 2 THEN 'attestation_urssaf'
      WHEN 3 THEN 'kbis' WHEN 4 THEN 'rib' ELSE 'courrier' END AS dt
  FROM {orders}
  UNION ALL
  SELECT o_orderkey, lpad(cast(o_custkey % 200 + 10000000 AS varchar(20)), 14, '8'),
    CASE WHEN o_orderkey % 19 < 4 THEN 'scans_fraud' ELSE 'scans' END, '.png',
    CASE o_orderkey % 6 WHEN 0 THEN 'facture' WHEN 1 THEN 'devis' WHEN 2 THEN 'attestation_urssaf'
      WHEN 3 THEN 'kbis' WHEN 4 THEN 'rib' ELSE 'courrier' END
  FROM {orders} WHERE o_orderkey % 5 < 3) b
"""

# Manifest and listing where one PDF in eleven is named in capitals, and one file in 31 is lost: it lies in no known folder.
FX_MANIFEST_ODD = f"""
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN replace(filename, '.pdf', '.PDF') ELSE filename END AS filename,
  doc_type, company_siret, company_name, is_fraud, folder
FROM ({FX_MANIFEST}) m
"""

FX_FILES_ODD = f"""
SELECT file_id, concat(CASE WHEN file_id % 31 = 0 THEN 'lost/' ELSE '' END,
  CASE WHEN file_id % 11 = 0 THEN replace(path, '.pdf', '.PDF') ELSE path END) AS path, length
FROM ({FX_FILES}) f
"""

# Positive texts and the whole negative corpus.
FX_PAGES = f"""
SELECT doc_id, text FROM ({FX_TEXT}) t
UNION ALL
SELECT 10000000000 + doc_id AS doc_id, text FROM {{documents}}
"""

# Bronze objects: a positive page followed by a whole document.
FX_CORPUS = f"""
SELECT d.doc_id,
  concat('raw/', d.source, '/',
    CASE d.doc_id % 3 WHEN 0 THEN 'facture' WHEN 1 THEN 'Devis' ELSE 'courrier' END, '_',
    lpad(cast(d.doc_id AS varchar(20)), 8, '0'),
    CASE d.doc_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' ELSE '.txt' END) AS key,
  concat(coalesce(t.text, ''), chr(10), d.text) AS text
FROM {{documents}} d LEFT JOIN ({FX_TEXT}) t ON t.doc_id = d.doc_id
"""

FX_GOLD = f"""
SELECT s.*,
  cast(doc_id * 37 % 101 AS double) / 100 AS fraud_score,
  cast(doc_id * 53 % 97 AS double) / 100 AS ml_probability,
  'ground-truth-naive-bayes-v1' AS model_version,
  CASE WHEN doc_id * 37 % 101 >= 75 THEN 'high' ELSE 'normal' END AS risk_level,
  CASE doc_id % 6 WHEN 0 THEN 'FRAUDE' WHEN 1 THEN 'suspect' WHEN 2 THEN NULL ELSE 'OK' END AS statut_fraude,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('motif ', cast(doc_id % 4 AS varchar(20))) END AS motif,
  CASE WHEN doc_id * 37 % 101 >= 75 THEN 1 ELSE 0 END AS ml_flag,
  CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'hier' ELSE
    concat('2025-', lpad(cast(1 + doc_id % 12 AS varchar(20)), 2, '0'), '-', lpad(cast(1 + doc_id % 28 AS varchar(20)), 2, '0'),
      'T', lpad(cast(doc_id % 24 AS varchar(20)), 2, '0'), ':', lpad(cast(doc_id % 60 AS varchar(20)), 2, '0'), ':07+00:00')
  END AS gold_imported_at
FROM ({FX_SILVER}) s
"""

# Dashboard records of another shape: other column names, blanks, a boolean and a text score.
FX_RECORDS = """
SELECT o_orderkey AS doc_id,
  CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('piece_', cast(o_orderkey AS varchar(20)), '.png') END AS file_name,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(
    CASE o_orderkey % 7 WHEN 0 THEN 'Facture' WHEN 1 THEN 'devis' WHEN 2 THEN 'urssaf' WHEN 3 THEN 'tribunal' ELSE 'note' END,
    '_', cast(o_orderkey AS varchar(20)), '.pdf') END AS nom_document,
  CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'Invoice FR' WHEN 2 THEN 'Extrait KBIS' WHEN 3 THEN NULL ELSE 'courrier' END AS doc_type,
  CASE o_orderkey % 10 WHEN 0 THEN 'fraud_confirmed' WHEN 1 THEN 'Anomalie' WHEN 2 THEN 'KO' WHEN 3 THEN '1' WHEN 4 THEN 'valid'
    WHEN 5 THEN 'OK' WHEN 6 THEN '0' WHEN 7 THEN 'inconnu' WHEN 8 THEN '' ELSE NULL END AS fraud_status,
  o_orderkey % 2 = 0 AS is_fraud,
  CASE o_orderkey % 6 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('raison ', cast(o_orderkey % 6 AS varchar(20))) END AS reason,
  CASE o_orderkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('2025-03-', lpad(cast(1 + o_orderkey % 28 AS varchar(20)), 2, '0'), 'T08:30:00+00:00') END AS created_at,
  CASE WHEN o_orderkey % 4 = 1 THEN concat('/view/', cast(o_orderkey AS varchar(20))) ELSE '' END AS previewUrl,
  CASE o_orderkey % 9 WHEN 0 THEN 'abc' WHEN 1 THEN '' WHEN 2 THEN 'NaN' WHEN 3 THEN NULL WHEN 4 THEN '-0.5' WHEN 5 THEN 'Infinity'
    WHEN 6 THEN '1d' WHEN 7 THEN '2e-1' ELSE '0.8125' END AS fraudScore
FROM {orders}
"""

FX_UPLOADS = """
SELECT event_id AS upload_id, event_id - event_id % 4 AS batch,
  concat('dossier_', cast(user_id AS varchar(20)),
    CASE user_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.Jpeg' WHEN 3 THEN '.docx' WHEN 4 THEN '.jpg'
      WHEN 5 THEN '.pdf' ELSE '' END) AS name,
  event_id % 5 AS size, user_id % 3 AS last_modified
FROM {events}
"""

# Company dimension; SIRETs repeat so that the first row has to win.
FX_COMPANIES = """
SELECT c_custkey AS company_no,
  lpad(cast(c_custkey % 1000 AS varchar(20)), 9, '5') AS siren,
  CASE WHEN c_custkey % 37 = 0 THEN '' ELSE lpad(cast(c_custkey % 1000 AS varchar(20)), 14, '5') END AS siret,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS nom,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE cast(c_custkey % 90 AS varchar(20)) END AS numero_voie,
  CASE WHEN c_custkey % 5 < 2 THEN NULL ELSE 'rue' END AS type_voie,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS libelle_voie,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE lpad(cast(c_nationkey AS varchar(20)), 5, '7') END AS code_postal,
  n.n_name AS ville,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(lpad(cast(c_nationkey AS varchar(20)), 2, '0'), '.10Z') END AS naf,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'SARL' END AS forme_juridique,
  CASE WHEN c_custkey % 6 = 0 THEN NULL WHEN c_custkey % 6 = 1 THEN '' ELSE 'Jeanne' END AS prenom,
  CASE WHEN c_custkey % 6 < 2 THEN '' ELSE concat('Nom', cast(c_custkey AS varchar(20))) END AS nom_dirigeant
FROM {customer} c JOIN {nation} n ON c_nationkey = n_nationkey
"""

FIXTURES = {name.lower(): value for name, value in globals().items() if name.startswith("FX_")}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection as a DataFrame over the tables of ``sf_dir``."""
    return project(spark, sf_dir, FIXTURES[name])


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one statement over the given tables; only the tables it names are opened."""
    used = [name for name in TABLES if "{" + name + "}" in sql]
    return spark.sql(sql, **{name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in used})


def for_duckdb(sql: str) -> str:
    return sql.format(**{name: name for name in TABLES})
