"""Company search responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake import constants as C, schemas
from dossierlake.functions import display
from dossierlake.functions.text import blank_to_null, strip
from dossierlake.operators.dedup import dedup_companies


def companies_from_search(
    responses: DataFrame, payload: str, page: str, default_director: str = "", stop_at: int | None = None
) -> DataFrame:
    """Flatten JSON responses to one row per company.

    Results without SIRET are skipped, later repeats of a SIRET are dropped in
    (page, position) order, and missing fields take their defaults, as do explicit nulls.
    """
    parsed = responses.select(
        F.col(page).alias("page"),
        F.posexplode(F.from_json(F.col(payload), schemas.COMPANY_SEARCH)["results"]).alias("position", "result"),
    )
    result, office = F.col("result"), F.col("result.siege")

    def with_default(value: Column, name: str) -> Column:
        return F.coalesce(value, F.lit(C.COMPANY_DEFAULTS[name]))

    def words(*parts: Column) -> Column:
        """Non-empty parts joined by a space, null when nothing remains."""
        return blank_to_null(strip(F.concat_ws(" ", *[blank_to_null(part) for part in parts])))

    director = F.get(result["dirigeants"], F.lit(0))
    rows = parsed.where(blank_to_null(office["siret"]).isNotNull()).select(
        "page",
        "position",
        F.coalesce(result["siren"], F.lit("")).alias("siren"),
        office["siret"].alias("siret"),
        with_default(result["nom_complet"], "nom").alias("nom"),
        with_default(words(office["numero_voie"], office["type_voie"], office["libelle_voie"]), "adresse").alias(
            "adresse"
        ),
        with_default(office["code_postal"], "code_postal").alias("code_postal"),
        with_default(office["libelle_commune"], "ville").alias("ville"),
        with_default(result["activite_principale"], "naf").alias("naf"),
        with_default(result["nature_juridique"], "forme_juridique").alias("forme_juridique"),
        with_default(result["date_creation"], "date_creation").alias("date_creation"),
        F.coalesce(words(director["prenom"], director["nom"]), F.lit(default_director)).alias("dirigeant"),
    )
    kept = dedup_companies(rows, ["page", "position"], stop_at)
    return kept.withColumn("tva_intra", display.vat_number(F.col("siren"), F.lit(None).cast("string"))).drop(
        "page", "position"
    )
