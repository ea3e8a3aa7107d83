"""Keys, paths and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierlake import constants as C


def stem(key: Column) -> Column:
    """Everything before the last dot."""
    return F.regexp_replace(key, r"\.[^.]*\z", "")


def silver_key(key: Column) -> Column:
    return F.concat(stem(key), F.lit(".parquet"))


def has_suffix(key: Column, suffixes: list[str]) -> Column:
    return F.lower(key).rlike(r"\.(" + "|".join(suffixes) + r")\z")


def gold_to_silver_key(key: Column) -> Column:
    """The silver key a gold key was routed from."""
    return F.regexp_replace(key, f"^({C.STANDARD_ZONE}|{C.HIGH_RISK_ZONE})/", "")


def media_kind(key: Column) -> Column:
    """Viewer used for a preview."""
    name = F.lower(F.coalesce(key, F.lit("")))
    return F.when(name.rlike(r"\.(" + "|".join(C.IMAGE_SUFFIXES) + ")"), "image").otherwise("pdf")


def media_type(key: Column) -> Column:
    return F.when(F.lower(key).endswith(".pdf"), "application/pdf").otherwise("application/octet-stream")


def upload_rejection(name: Column, written: Column | None = None) -> Column:
    """Reason an upload failed, null when accepted: its format, or, where ``written`` says so, its storage."""
    reason = F.when(~F.coalesce(has_suffix(name, C.UPLOAD_SUFFIXES), F.lit(False)), C.REJECT_REASON)
    return reason if written is None else reason.when(~F.coalesce(written, F.lit(False)), C.WRITE_REASON)


def preview_url(source_file: Column) -> Column:
    """View link with the key percent-encoded; slashes and tildes stay readable."""
    quoted = F.url_encode(source_file)
    for encoded, plain in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        quoted = F.replace(quoted, F.lit(encoded), F.lit(plain))
    return F.when(F.coalesce(source_file, F.lit("")) == "", "").otherwise(F.concat(F.lit(C.PREVIEW_PREFIX), quoted))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; paths elsewhere stay as they are."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)
