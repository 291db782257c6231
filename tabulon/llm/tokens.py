"""Words of whole Arrow columns as numbers: texts are split and numbered without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts, words of each text). A word is a run of characters other
    than space and the five controls from tab to carriage return, A-Z in lower case; a null text has none."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    offsets = split.offsets.to_numpy().astype(np.int64)
    coded = split.values[offsets[0] : offsets[-1]].dictionary_encode() if len(offsets) else pa.array([], pa.string()).dictionary_encode()
    offsets = offsets - (offsets[0] if len(offsets) else 0)
    words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
    number = coded.indices.to_numpy().astype(np.int64)
    each = np.diff(offsets)
    if b"" in words:  # beside leading or trailing white space
        none = words.index(b"")
        real = number != none
        before = np.append(0, np.cumsum(real))
        each = before[offsets[1:]] - before[offsets[:-1]]
        number = number[real]
        number -= number > none
        del words[none]
    return words, number, each


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word of all texts, words of each text)."""
    import xxhash

    words, number, each = numbered(texts)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[number], each


def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they end, free memory goes back to the system, since Python workers live on."""
    yield from batches
    trim()


def trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps its pages
        return
