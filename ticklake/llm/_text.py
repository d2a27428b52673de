"""Vectorised views of Arrow string columns: rows, words and byte n-grams as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RANDOM = np.random.default_rng(20240229)
#: A random odd 64-bit value per byte, and the base of the word hash.
BYTE_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and the rows' borders in them (one more than rows); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(batch: pa.RecordBatch, text: int, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with at most ``most`` bytes of text (a longer row stands alone), with ``utf8`` of each."""
    if not batch.num_rows:
        return
    raw, at = utf8(batch.column(text))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Words:
    """Maximal runs of word bytes in each row.

    start, end: byte borders; row: the row of each word; hash: 64 bits of its lower-cased bytes (A-Z only).
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, word_byte: np.ndarray):
        inside = word_byte[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = at[:-1][at[:-1] < len(raw)]
        first[edges] = inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = at[1:][at[1:] > 0] - 1
        last[ends] = inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.row = np.searchsorted(at, self.start, "right") - 1
        if not len(self.start):
            self.hash = np.zeros(0, np.uint64)
            return
        length = self.end - self.start
        where = np.flatnonzero(inside)
        offset = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
        power = np.ones(int(length.max()), np.uint64)
        np.multiply.accumulate(np.full(len(power) - 1, BASE), out=power[1:])
        total = np.add.reduceat(BYTE_VALUE[LOWER[raw[where]]] * power[offset], np.cumsum(length) - length)
        self.hash = mix(total)

    def counts(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(inside: str) -> np.ndarray:
    """Truth table of bytes: ``space`` splits at ASCII white space, ``alnum`` keeps ASCII letters, digits and all beyond ASCII."""
    b = np.arange(256)
    if inside == "space":
        return ~((b == 0x20) | ((b >= 0x09) & (b <= 0x0D)))
    return ((b >= 0x30) & (b <= 0x39)) | ((b >= 0x41) & (b <= 0x5A)) | ((b >= 0x61) & (b <= 0x7A)) | (b >= 0x80)


def byte_grams(raw: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """For each byte, ``order`` bytes before it (NUL before a row's start) and itself, as one integer, itself lowest."""
    key = raw.astype(np.uint64)
    for j in range(1, order + 1):
        before = np.zeros(len(raw), np.uint64)
        before[j:] = raw[:-j]
        for t in range(j):
            edge = at[:-1] + t
            before[edge[edge < at[1:]]] = 0
        key |= before << np.uint64(8 * j)
    return key


def grams_counted(raw: np.ndarray, at: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each byte's gram among the distinct grams, those, and how often each occurs."""
    import pandas as pd

    code, found = pd.factorize(byte_grams(raw, at, order))
    return code, found, np.bincount(code, minlength=len(found))
