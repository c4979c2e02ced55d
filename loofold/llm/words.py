"""Words of whole texts as numbers, for code that runs inside tasks.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, so splitting UTF-8 bytes equals splitting code points.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(sizes: list[int], limit: int) -> Iterator[slice]:
    """Consecutive runs of rows whose sizes add up to about ``limit``; a larger row is alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield slice(begin, len(sizes))


def parts(column: pa.Array, limit: int) -> Iterator[tuple[slice, list[bytes]]]:
    """A column's rows a few megabytes of text at a time, with the texts of each part."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    for part in slices(sizes, limit):
        yield part, texts_of(column.slice(part.start, part.stop - part.start))


def release() -> None:
    """Gives freed memory back at the end of a partition; reused workers else keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def starts(counts: np.ndarray) -> np.ndarray:
    """Where each run begins, and after the last where it ends."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions begin[i], begin[i]+1, .. of all runs, one after another."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(begin - (ends - counts), counts) + np.arange(total)


def coded(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Codes of all words, the distinct words by code, and where each text's words begin."""
    lists = [t.split() for t in texts]
    bounds = starts(np.fromiter(map(len, lists), np.int64, len(lists)))
    words = list(chain.from_iterable(lists))
    distinct = list(dict.fromkeys(words))
    code = dict(zip(distinct, range(len(distinct)), strict=True))
    return np.fromiter(map(code.__getitem__, words), np.int64, len(words)), distinct, bounds


def coded_column(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The same of a column of texts in lower case A-Z, split and told apart by Arrow; null is empty."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    found = split.flatten().dictionary_encode()
    raw, words = found.dictionary.cast(pa.binary()), []
    if len(raw):
        data = raw.buffers()[2].to_pybytes() if raw.buffers()[2] else b""
        at = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].tolist()
        words = [data[i:j] for i, j in pairwise(at)]
    codes, bounds = found.indices.to_numpy().astype(np.int64), starts(split.value_lengths().to_numpy())
    if b"" in words:  # what stands before white space that begins a text, or behind its last
        none = words.index(b"")
        inside = codes != none
        bounds = starts(inside)[bounds]
        codes = codes[inside]
        codes -= codes > none
        del words[none]
    return codes, words, bounds
