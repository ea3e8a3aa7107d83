"""Two document-type normalisers: one for scoring, one for the dashboard."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from dossierlake import constants as C


def _first_label(words: dict[str, list[str]], matches: Callable[[str], Column]) -> Column:
    """First label with a matching word, null when none matches."""
    hits = [F.when(reduce(or_, map(matches, options)), label) for label, options in words.items()]
    return F.coalesce(*hits)


def _alone_in(text: Column) -> Callable[[str], Column]:
    """Test for a word that is the whole text, whitespace around it aside."""
    return lambda word: text.rlike(rf"(?U)^[\s\x1c-\x1f]*{word}[\s\x1c-\x1f]*\z")


def normalize(doc_type: Column, file_name: Column) -> Column:
    """Scoring type: the declared type decides, then the file name."""
    raw, name = F.lower(F.coalesce(doc_type, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    return F.coalesce(
        _first_label(C.TYPE_NAMES, _alone_in(raw)),
        _first_label(C.TYPE_WORDS, raw.contains),
        _first_label(C.FILE_WORDS, name.contains),
        F.lit(C.UNKNOWN_TYPE),
    )


def dashboard_type(doc_type: Column, file_name: Column) -> Column:
    """Dashboard type: every word is a substring test, labels are upper-case."""
    raw, name = F.lower(F.coalesce(doc_type, F.lit(""))), F.lower(F.coalesce(file_name, F.lit("")))
    return F.coalesce(
        _first_label(C.DASHBOARD_TYPE_WORDS, raw.contains),
        _first_label(C.DASHBOARD_FILE_WORDS, name.contains),
        F.lit("AUTRE"),
    )


def requires(doc_type: Column, field: str) -> Column:
    """Whether documents of this type must carry the field."""
    return doc_type.isin([name for name, fields in C.REQUIRED_FIELDS.items() if field in fields])
