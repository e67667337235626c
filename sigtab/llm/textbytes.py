"""Small array helpers on the UTF-8 bytes of texts, used inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = 0x20

#: Bytes with A-Z as a-z, other ASCII but letters as a space; bytes above 0x7F stay.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else SPACE for b in range(256)], np.uint8)


def documents(column: pa.Array | pa.ChunkedArray):
    """The bytes of each text of an Arrow column as an array; a null counts as an empty text."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        chunk = chunk.cast(pa.large_string())
        if not len(chunk):
            continue
        _, ends, data = chunk.buffers()
        ends = np.frombuffer(ends, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        known = chunk.is_valid().to_numpy(zero_copy_only=False)
        for k in range(len(chunk)):
            yield data[ends[k] : ends[k + 1]] if known[k] else data[:0]


def folded(text: np.ndarray) -> np.ndarray:
    """Letters in lower case (ASCII and Latin-1), everything else as single spaces, one at each end."""
    out = np.empty(len(text) + 2, np.uint8)
    out[0] = out[-1] = SPACE
    np.take(LETTERS, text, out=out[1:-1])
    lead = np.flatnonzero(out[:-1] == 0xC3) + 1
    tail = out[lead]
    lead = lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)]
    out[lead] += 0x20
    blank = out == SPACE
    return out[np.append(True, ~(blank[1:] & blank[:-1]))]


def codes(text: np.ndarray, n: int) -> np.ndarray:
    """The n-grams of bytes (n up to 8) as unsigned integers, in order."""
    kind = np.uint32 if n <= 4 else np.uint64
    if len(text) < n:
        return np.empty(0, kind)
    wide = text.astype(kind)
    out = wide[: len(text) - n + 1].copy()
    for k in range(1, n):
        out <<= kind(8)
        out |= wide[k : len(text) - n + 1 + k]
    return out


def mixed(codes: np.ndarray, bits: int, salt: int = 0) -> np.ndarray:
    """A hash of each code with so many bits."""
    h = codes.astype(np.uint64) + np.uint64(1 + salt)
    h *= np.uint64((0x9E3779B97F4A7C15 + 2 * salt * 0x632BE59BD9B4E019) % (1 << 64) | 1)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)
