"""Match manifest rows to the files that exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierlake.functions import files
from dossierlake.functions.text import strip


def known_by_document(listing: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """One row per (company, document stem): ``found``, the files as folder/file name, and ``read``, what their texts hold.

    ``listing`` carries ``path`` as folder/company/file name; ``texts`` carries
    company_siret, filename and a struct ``findings``. Both are folded in one
    aggregate. Files and texts without a company or a name belong to nothing.
    """
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    known = listing.select(
        F.get(parts, F.lit(1)).alias("company_siret"),
        files.stem(name).alias("document"),
        F.concat_ws("/", F.get(parts, F.lit(0)), name).alias("file"),
    )
    if texts is not None:
        read = F.struct(F.col("filename").alias("name"), "findings")
        known = known.unionByName(texts.select("company_siret", files.stem(F.col("filename")).alias("document"), read.alias("text")), allowMissingColumns=True)
    folded = [F.collect_set("file").alias("found")] + ([F.collect_set("text").alias("read")] if texts is not None else [])
    return known.where(F.col("company_siret").isNotNull() & F.col("document").isNotNull()).groupBy("company_siret", "document").agg(*folded)


def _choose(clean: str, fraud: str, name: Column, hint: Column, is_fraud: Column) -> Column:
    """The folder that holds ``name``: a hint decides; without one the folder matching the label is tried first.

    Names are compared as a whole, so a suffix in capitals matches itself only.
    """

    def within(folder: str) -> Column:
        return F.when(F.array_contains("found", F.concat(F.lit(f"{folder}/"), name)), F.lit(folder))

    return (
        F.when(hint == "raw_fraud", within(fraud))
        .when(hint == "raw", within(clean))
        .when(is_fraud, F.coalesce(within(fraud), within(clean)))
        .otherwise(F.coalesce(within(clean), within(fraud)))
    )


def resolve_paths(manifest: DataFrame, listing: DataFrame, is_fraud: Column, texts: DataFrame | None = None) -> DataFrame:
    """Add ``document``, ``pdf_path`` and ``scan_path``; a path is null when no file exists.

    All come from one equi-join, because the listing is folded to one row per
    document first, so a manifest row never becomes two. With ``texts`` the
    column ``findings`` holds what the text of the very file ``filename`` says
    (of several texts the one that sorts first), null without one.
    """
    keyed = manifest.withColumn("document", files.stem(F.col("filename")))
    joined = keyed.join(known_by_document(listing, texts), ["company_siret", "document"], "left")
    hint = F.lower(strip(F.coalesce(F.col("folder"), F.lit(""))))
    scan = F.concat("document", F.lit(".png"))

    def path(folder: Column, name: Column) -> Column:
        return F.concat(folder, F.lit("/"), F.col("company_siret"), F.lit("/"), name)

    return joined.select(
        *[F.col(name) for name in manifest.columns],
        "document",
        path(_choose("raw", "raw_fraud", F.col("filename"), hint, is_fraud), F.col("filename")).alias("pdf_path"),
        path(_choose("scans", "scans_fraud", scan, hint, is_fraud), scan).alias("scan_path"),
        *([] if texts is None else [F.array_min(F.filter("read", lambda text: text["name"] == F.col("filename")))["findings"].alias("findings")]),
    )


def unresolved(resolved: DataFrame) -> DataFrame:
    """Rows whose PDF is missing; the ground-truth job refuses to run with any unless told to skip them."""
    return resolved.where(F.col("pdf_path").isNull())
