"""Hand-written edge rows; expected values were derived by reading the rules."""

import pytest
from pyspark.sql import functions as F

from dossierlake import schemas
from dossierlake.functions import display, doctype, evidence, extract, files, risk, text
from dossierlake.plans import checks


def value(spark, column, **inputs):
    """Evaluate an expression over one row of text columns; an optimizer barrier keeps it from being folded."""
    names = list(inputs)
    schema = ", ".join(f"{name} {'binary' if isinstance(inputs[name], bytes) else 'string'}" for name in names)
    return spark.createDataFrame([tuple(inputs.values())], schema).select(column.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("TOTAL HT 12.00 Total TTC 14.40", 12.0),
        ("Montant : 1 234.50", 1234.5),
        ("montant dû 1 234,56 €", 1234.56),
        ("total 12345678901234567890123 aucun", None),
        ("ttc" + " " * 3 + "x" * 25 + " 10.00", None),
        ("aucun montant", None),
    ],
)
def test_amount(spark, raw, expected):
    assert value(spark, extract.amount(text.collapse_whitespace(F.col("t"))), t=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("123456789012345678", "12345678901234"),
        ("Siret n° : 12345678901234", "12345678901234"),
        ("SIRET 123 puis 99999999999999", "99999999999999"),
        ("01234567890123 siret 11111111111111", "01234567890123"),
        ("1234567890123", None),
    ],
)
def test_siret(spark, raw, expected):
    assert value(spark, extract.siret(F.col("t")), t=raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("Facturé à X", "unknown"),
        ("factureé", "unknown"),
        ("la FACTURE et le devis", "invoice"),
        ("Quotation 12", "quote"),
        ("devisager", "unknown"),
    ],
)
def test_document_kind(spark, raw, expected):
    assert value(spark, extract.document_kind(F.col("t")), t=raw) == expected


@pytest.mark.parametrize("raw, expected", [("document expiré", False), ("expire", True), ("Pièce INVALIDE.", True)])
def test_mentions_expired(spark, raw, expected):
    assert value(spark, extract.mentions_expired(F.col("t")), t=raw) is expected


@pytest.mark.parametrize(
    "raw, expected",
    [
        (b"A\xffB", "AB"),
        (b" \t caf\xc3\xa9 \n", "café"),
        (" x�y\x1c".encode() + b"\xc3", "x�y"),
        (b"\xed\xa0\x80ok", "ok"),
        ("a\uffff0\uffff1\ufffd\uffff".encode() + b"\xff", "a\uffff0\uffff1\ufffd\uffff"),
    ],
)
def test_lossy_utf8(spark, raw, expected):
    assert value(spark, text.lossy_utf8(F.col("c")), c=raw) == expected
    assert expected == raw.decode("utf-8", errors="ignore").strip()


def test_flatten_words(spark):
    export = '{"pages":[{"blocks":[{"lines":[{"words":[{"value":"a"},{"value":""},{"value":null}]},{}]},{}]},{"blocks":[{"lines":[{"words":[{"value":"b"}]}]}]}]}'
    assert value(spark, text.flatten_words(F.from_json("j", schemas.OCR_EXPORT)), j=export) == "a b"
    assert value(spark, text.flatten_words(F.from_json("j", schemas.OCR_EXPORT)), j="{}") == ""


@pytest.mark.parametrize(
    "name, body, expected",
    [
        ("Facture_1.pdf", "total", "facture total"),
        ("facture_devis.png", "total", "devis facture total"),
        ("devis.pdf", "un Devis", "un Devis"),
        ("facture.txt", "total", "total"),
    ],
)
def test_type_hint(spark, name, body, expected):
    assert value(spark, text.with_type_hint(F.col("n"), F.col("b")), n=name, b=body) == expected


@pytest.mark.parametrize(
    "name, error, expected",
    [
        ("a.TXT", "ValueError", "fallback_text_reader"),
        ("a.pdf", None, "doctr"),
        ("a.pdf", "OSError", "fallback_text_reader (OSError)"),
    ],
)
def test_engine_tag(spark, name, error, expected):
    assert value(spark, text.engine_tag(F.col("n"), F.col("e")), n=name, e=error) == expected


@pytest.mark.parametrize(
    "declared, name, expected",
    [
        (" Invoice\n", "", "facture"),
        ("invoices", "", "unknown"),
        ("DEVIS", "facture.pdf", "devis"),
        ("avis urssaf", "", "attestation_urssaf"),
        (None, "tribunal.pdf", "rib"),
        ("autre", "x_Kbis_rib.pdf", "kbis"),
        (None, None, "unknown"),
    ],
)
def test_scoring_type(spark, declared, name, expected):
    assert value(spark, doctype.normalize(F.col("d"), F.col("n")), d=declared, n=name) == expected


@pytest.mark.parametrize(
    "declared, name, expected",
    [("invoices", "", "FACTURE"), ("x", "my_quote.pdf", "AUTRE"), ("x", "attestation.pdf", "ATTESTATION_URSSAF")],
)
def test_dashboard_type(spark, declared, name, expected):
    assert value(spark, doctype.dashboard_type(F.col("d"), F.col("n")), d=declared, n=name) == expected


@pytest.mark.parametrize(
    "owner, body, expected",
    [
        ("22222222222222", "SIRET : 11111111111111 x SIRET : 22222222222222", "22222222222222"),
        ("33333333333333", "SIRET : 11111111111111 x SIRET : 22222222222222", "11111111111111"),
        ("33333333333333", "rien", "33333333333333"),
        ("33333333333333", "siret ( 44444444444444)", "44444444444444"),
    ],
)
def test_ground_truth_siret(spark, owner, body, expected):
    assert value(spark, evidence.siret(F.col("t"), F.col("o")), t=body, o=owner) == expected


def test_ground_truth_fields(spark):
    body = "SIRET (siège) : 55555555555555 Total HT 1 200,50 € total ttc 1 440.60 € Du 01/02/2025 au 31/07/2025"
    assert value(spark, evidence.head_office_siret(F.col("t"), F.lit("x")), t=body) == "55555555555555"
    assert value(spark, evidence.total_ht(F.col("t")), t=body) == "1200.50"
    assert value(spark, evidence.total_ttc(F.col("t")), t=body) == "1 440.60"
    assert value(spark, evidence.validity_end(F.col("t")), t=body) == "2025-07-31"
    assert value(spark, evidence.validity_end(F.col("t")), t="du 01/02/2025 au 31/07/2025") == ""


@pytest.mark.parametrize("raw, expected", [(" TRUE ", True), ("y", True), ("oui", False), ("", False), (None, False)])
def test_parse_bool(spark, raw, expected):
    assert value(spark, evidence.parse_bool(F.col("t")), t=raw) is expected


def test_rule_score_rounding(spark):
    """0.05 + 0.25 + 0.15 falls just short of 0.45, the rounded score does not."""
    none = F.lit(None).cast("double")
    raw = risk.rule_score(F.lit("kbis"), F.col("s"), none, F.lit(False), F.lit(True), none, none, none)
    assert value(spark, raw, s=None) == 0.05 + 0.25 + 0.15 == 0.44999999999999996
    assert value(spark, risk.verdict(F.round(raw, 4), F.lit(0.0), F.lit(1)), s=None) == "SUSPECT"


def test_rule_score_is_capped(spark):
    one = F.lit(1.0)
    raw = risk.rule_score(F.lit("facture"), F.col("s"), F.lit(5.0), F.lit(True), F.lit(True), one, one, one)
    assert value(spark, raw, s="") == 1.0


def test_nan_amount_counts_as_missing(spark):
    amount = F.lit(float("nan"))
    assert value(spark, risk.amount_band(amount, F.lit(1.0), F.lit(2.0)), x="") == "missing"
    found = risk.issues(F.lit("facture"), F.lit("1"), amount, F.lit(False))
    assert value(spark, risk.issue_text(found), x="") == "Montant manquant"


def test_issue_order(spark):
    found = risk.issues(F.lit("unknown"), F.lit(""), F.lit(100000.01), F.lit(True))
    assert value(spark, risk.issue_text(found), x="") == "Type document inconnu, Document expire, Montant suspect eleve"
    assert value(spark, risk.issue_count(found), x="") == 3
    none = risk.issues(F.lit("rib"), F.lit(""), F.lit(100000.0), F.lit(False))
    assert value(spark, risk.issue_text(none), x="") == "" and value(spark, risk.issue_count(none), x="") == 0


def test_summary_shows_two_alerts_at_most(spark):
    alerts = display.alerts(F.lit("unknown"), F.lit(""), F.lit(True))
    assert value(spark, display.fraud_summary(F.lit(0.8), alerts), x="").count(".") == 2
    assert value(spark, display.fraud_summary(F.lit(0.1), alerts), x="") == "Information utile : Le document semble expire."
    missing = display.alerts(F.lit("kbis"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    assert value(spark, display.fraud_summary(F.lit(0.45), missing), x="") == (
        "Points a verifier : Certaines informations obligatoires sont absentes."
    )


def test_blend_floor_for_expired(spark):
    expired = risk.blend(F.lit(0.1), F.lit(0.2), F.lit(0.18), F.lit(True))
    fresh = risk.blend(F.lit(1.0), F.lit(0.2), F.lit(0.18), F.lit(False))
    assert value(spark, expired, x="") == 0.9
    assert value(spark, fresh, x="") == pytest.approx(0.45 + 0.09 + 0.018)


def test_preview_url(spark):
    shown = value(spark, files.preview_url(F.col("k")), k="a b/c~d*é+(x).pdf")
    assert shown == "/api/v1/documents/view?key=a%20b/c~d%2A%C3%A9%2B%28x%29.pdf"
    assert value(spark, files.preview_url(F.col("k")), k=None) == ""


@pytest.mark.parametrize(
    "key, expected", [("a/b.c.pdf", "a/b.c.parquet"), ("a.b/c", "a.parquet"), ("sans", "sans.parquet")]
)
def test_silver_key(spark, key, expected):
    assert value(spark, files.silver_key(F.col("k")), k=key) == expected


@pytest.mark.parametrize(
    "raw, expected", [("abc", 0.0), ("1e-1", 0.1), ("Infinity", 0.0), ("1d", 0.0), (" 2 ", 2.0), (None, 0.0)]
)
def test_dashboard_score(spark, raw, expected):
    assert value(spark, display.dashboard_score(F.col("t")), t=raw) == expected


def test_date_label_uses_the_given_zone(spark):
    stamp = "2025-07-01T22:30:00+00:00"
    assert value(spark, display.date_label(F.col("t")), t=stamp) == "01/07/2025 22:30"
    assert value(spark, display.date_label(F.col("t"), "Europe/Paris"), t=stamp) == "02/07/2025 00:30"
    assert value(spark, display.date_label(F.col("t")), t="hier") == "-"


def test_printed_formats(spark):
    assert value(spark, display.money(F.lit(1234567.5)), x="") == "1 234 567.50"
    assert value(spark, display.iban_groups(F.col("t")), t="FR7617106000451") == "FR76 1710 6000 451"
    assert value(spark, display.vat_number(F.col("s"), F.lit("")), s="123456789") == "FR12123456789"


def test_iban_checks(spark):
    bad, good = "FR99 1234 5678 9012 3456 7890 123", "FR14 2004 1010 0505 0001 3M02 606"
    compact = checks.compact_iban(F.col("t"))
    assert value(spark, checks.iban_check_digits_valid(compact), t=bad) is False
    assert value(spark, checks.iban_check_digits_valid(compact), t=good) is True
    assert value(spark, checks.iban_remainder(compact), t=good) == 1
    assert value(spark, checks.iban_remainder(compact), t=bad) != 1
