"""Text clean-up shared by the extractors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dossierlake import constants as C

# Whitespace as Unicode defines it plus the four ASCII separators.
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_SPACE_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0     　" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_REPLACEMENT = "�"
_ESCAPE = "\uffff"


def strip(text: Column) -> Column:
    """Trim Unicode whitespace at both ends."""
    return F.btrim(text, F.lit(_SPACE_CHARS))


def collapse_whitespace(text: Column) -> Column:
    """Turn each whitespace run into one space, then trim."""
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def lossy_utf8(content: Column) -> Column:
    """Decode bytes, dropping invalid sequences and keeping real replacement characters."""
    raw = content.cast("string")
    # Real replacement characters are written as the escape character and 1 meanwhile, the escape character as itself and 0.
    escaped = F.replace(F.replace(raw, F.lit(_ESCAPE), F.lit(_ESCAPE + "0")), F.lit(_REPLACEMENT), F.lit(_ESCAPE + "1"))
    valid = F.replace(F.make_valid_utf8(escaped), F.lit(_REPLACEMENT), F.lit(""))
    repaired = F.replace(F.replace(valid, F.lit(_ESCAPE + "1"), F.lit(_REPLACEMENT)), F.lit(_ESCAPE + "0"), F.lit(_ESCAPE))
    return strip(F.when(F.is_valid_utf8(raw), raw).otherwise(repaired))


def flatten_words(export: Column) -> Column:
    """Join the non-empty words of a pages/blocks/lines/words export."""

    def inner(items: Column, field: str) -> Column:
        # A missing level counts as empty, otherwise flatten would null the whole result.
        return F.flatten(F.transform(items, lambda item: F.coalesce(item[field], F.array())))

    pages = F.coalesce(export["pages"], F.array())
    words = inner(inner(inner(pages, "blocks"), "lines"), "words")
    values = F.transform(words, lambda word: word["value"])
    return F.array_join(F.filter(values, lambda value: value.isNotNull() & (value != "")), " ")


def is_plain_text(file_name: Column) -> Column:
    return F.lower(file_name).endswith(".txt")


def document_text(file_name: Column, content: Column, ocr_text: Column, ocr_error: Column) -> Column:
    """OCR output, or the decoded bytes for text files and failed OCR."""
    use_bytes = is_plain_text(file_name) | ocr_error.isNotNull()
    return F.when(use_bytes, F.coalesce(lossy_utf8(content), F.lit(""))).otherwise(F.coalesce(ocr_text, F.lit("")))


def engine_tag(file_name: Column, ocr_error: Column) -> Column:
    """Name of the reader that produced the text."""
    return (
        F.when(is_plain_text(file_name), F.lit(C.FALLBACK_ENGINE))
        .when(ocr_error.isNotNull(), F.concat(F.lit(C.FALLBACK_ENGINE + " ("), ocr_error, F.lit(")")))
        .otherwise(F.lit(C.OCR_ENGINE))
    )


def with_type_hint(file_name: Column, text: Column) -> Column:
    """Prefix the type named by the file when the text does not mention it."""
    name, body = F.lower(file_name), F.lower(text)

    def hint(word: str) -> Column:
        missing = name.contains(word) & ~body.contains(word)
        return F.when(missing, F.lit(word + " ")).otherwise(F.lit(""))

    hinted = F.concat(hint("devis"), hint("facture"), text)
    return F.when(is_plain_text(file_name), text).otherwise(hinted)


def stored_text(text: Column, chars: int | None = None) -> Column:
    """What the silver table keeps: the whole text, or its first ``chars`` characters where a caller asks for them."""
    return text if chars is None else F.substring(text, 1, chars)


def parse_number(text: Column) -> Column:
    """Decimal text to double; anything else becomes null."""
    plain = text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    return F.when(plain, text.try_cast("double"))


def finite(number: Column) -> Column:
    """NaN and both infinities become null."""
    bad = F.isnan(number) | (F.abs(number) == F.lit(float("inf")))
    return F.when(~bad, number)
