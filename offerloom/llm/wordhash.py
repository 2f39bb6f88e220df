"""Hashes of words and of runs of words for many texts at once, in numpy.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from offerloom.llm.common import ship

ship(__name__)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Text that is hashed at once, about; a longer text is on its own.
PIECE_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers (the finalizer of a public-domain hash)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def pieces(texts: list, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes (or characters)."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def text_slices(column: pa.Array, size: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, texts) of stretches of a column of about ``size`` bytes; only one stretch is Python objects."""
    lengths = np.nan_to_num(pc.binary_length(column).to_numpy(zero_copy_only=False)).astype(np.int64) + 1
    number = (np.cumsum(lengths) - 1) // size
    cuts = np.r_[0, np.flatnonzero(number[1:] != number[:-1]) + 1, len(column)] if len(column) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield a, b, [t.encode() for t in column.slice(a, b - a).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, in order, and the text each belongs to."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    blank = BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(raw))[:-1], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    first = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(first, starts - 1, side="right") - 1


def run_hashes(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of every run of ``length`` words (one for each start; runs may cross texts)."""
    n = max(len(words) - length + 1, 0)
    out = np.full(n, seed, np.uint64)
    for k in range(length):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n]
    return mix(out)
