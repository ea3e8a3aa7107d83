"""Words of many texts at once, as arrays: the bytes of an Arrow column are classed, cut and encoded without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dossierlake.llm.common import slices, text_of

#: Bytes of text that are cut at a time; a longer text is cut alone.
STREAM_BYTES = 4 << 20
WORD, GAP, BREAK = 0, 1, 2
#: Fixed value: the characters between words of the text contracts.
PLAIN_GAPS = b" \t\n\x0b\x0c\r"


def classes(gaps: bytes, breaks: bytes = b"") -> np.ndarray:
    """The class of each byte. All separators are ASCII, so they never stand inside a longer UTF-8 character."""
    table = np.zeros(256, np.uint8)
    table[list(gaps)] = GAP
    table[list(breaks)] = BREAK
    return table


class Stream:
    """The words of a column of texts, in order.

    ``words`` holds them as bytes, ``row`` the text each belongs to, ``segment`` a number that changes with the text and at
    every break inside it. Null texts have no words. Bytes that are not UTF-8 are word bytes like any others.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool = False) -> None:
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        if texts.null_count:
            texts = pc.fill_null(texts.cast(pa.large_binary() if wide else pa.binary()), b"")
        _, at, data = texts.buffers()
        offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        if lower:
            raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
        kind = table[raw]
        inside = kind == WORD
        first = np.ones(len(raw) + 1, bool)  # where no word goes on from the byte before
        first[1:-1] = ~inside[:-1]
        first[offsets] = True
        starts = np.flatnonzero(inside & first[:-1])
        first[:-1] |= ~inside
        ends = np.flatnonzero(inside & first[1:]) + 1
        self.rows = len(texts)
        self.row = np.searchsorted(offsets, starts, side="right") - 1
        self.segment = self.row + np.cumsum(kind == BREAK)[starts] if len(starts) else self.row
        bounds = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=bounds[1:])
        self.words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw[inside]))])

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the distinct words these numbers name."""
        both = self.words.dictionary_encode()
        return both.indices.to_numpy(zero_copy_only=False).astype(np.int64), both.dictionary


def streams(batches: Iterator[pa.RecordBatch], column: str, table: np.ndarray, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Stream]]:
    """Parts of the batches of about STREAM_BYTES of text, a row at least, with their words."""
    for piece in slices(batches, column, STREAM_BYTES):
        yield piece, Stream(text_of(piece, column), table, lower)


def named(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names 0, 1, ... of equal codes, and how many there are of each."""
    _, names, counts = np.unique(codes, return_inverse=True, return_counts=True)
    return names.astype(np.int64), counts
