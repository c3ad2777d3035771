"""Words of whole Arrow batches as byte spans (numpy, no Python object per word).

Every delimiter of the contracts is an ASCII byte, and no byte of a longer
UTF-8 character is one, so spans can be cut on the bytes.
"""

from __future__ import annotations

import numpy as np

LOWER_TABLE = np.arange(256, dtype=np.uint8)
LOWER_TABLE[0x41:0x5B] += 0x20


def byte_set(chars: str) -> np.ndarray:
    """256 booleans: True at the given ASCII characters."""
    table = np.zeros(256, bool)
    table[list(chars.encode("ascii"))] = True
    return table


def utf8(column):
    """(bytes, offsets from 0) of a string or binary column; NULL is empty."""
    import pyarrow as pa
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    col = column.fill_null("" if text else b"").cast(pa.large_string() if text else pa.large_binary())
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of True that cross no document border."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    border = np.zeros(len(inside) + 1, bool)
    border[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | border[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | border[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def coded(raw: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(code per run, distinct strings as an Arrow array); the runs are those of ``inside``."""
    import pyarrow as pa
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    strings = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(raw[inside]))
    named = strings.dictionary_encode()
    return named.indices.to_numpy().astype(np.int64), named.dictionary


def slices(lengths: np.ndarray, most: int):
    """(first, last) ranges of rows whose lengths add up to about ``most`` or one row."""
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if len(lengths):
        yield first, len(lengths)


def gather(flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, begins: np.ndarray | None = None) -> np.ndarray:
    """The runs of ``flat`` (of the given sizes, by default one after the other) that ``codes`` name, one after the other."""
    per = sizes[codes]
    total = int(per.sum())
    places = np.int32 if max(len(flat), total) < 1 << 31 else np.int64
    begins = np.cumsum(sizes) - sizes if begins is None else begins
    shift = (begins[codes] - (np.cumsum(per) - per)).astype(places)
    return flat[np.arange(total, dtype=places) + np.repeat(shift, per)]
