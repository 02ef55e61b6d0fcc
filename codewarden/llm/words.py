"""Words of whole texts and their hashes, read off UTF-8 bytes with numpy.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. All work goes over a
batch's bytes at once, in blocks that end between words, so memory follows the batch and not the
longest text. Hashes depend on the bytes alone: every task, run and machine gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes hashed in one go; a longer word makes its own block.
BLOCK = 1 << 20

#: Bytes of text that a task works on at once; a longer text makes its own strip.
STRIP = 4 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: For texts that are compared without their punctuation: all ASCII but letters and digits.
IS_GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, at least ``size`` of them."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        steps = np.full(max(size, BLOCK + 1), base, U64)
        steps[0] = 1
        table = np.cumprod(steps, dtype=U64)
        if len(table) <= 4 * BLOCK:  # the table for a giant word is not kept
            _powers[base] = table
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def seeds(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x632BE59BD9B4E019) + U64(salt)) | U64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, each text's bounds in them, and which are not null."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, bool)
    _, bounds, data = texts.buffers()
    bounds = np.frombuffer(bounds, wide)[texts.offset : texts.offset + len(texts) + 1]
    bounds = bounds.astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    known = np.asarray(texts.is_valid())
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0], known


def strips(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``STRIP`` bytes of text, which bound a task's arrays."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        number = np.cumsum(size.to_numpy(zero_copy_only=False), dtype=np.int64) // STRIP
        cuts = [0, *(np.flatnonzero(np.diff(number)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def word_spans(
    raw: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and where each text's words begin among them."""
    space = gaps[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    first = ~space
    first[1:] &= space[:-1] | edge[1:-1]
    last = ~space
    last[:-1] &= space[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, bounds)


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of lower-cased bytes; spans are in order and don't overlap."""
    out = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        base = starts[at]
        upto = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        size = int(ends[upto - 1] - base)
        sums = np.zeros(size + 1, U64)
        np.cumsum(
            (LOWERED[raw[base : base + size]].astype(U64) + U64(1))
            * _power_table(_BASE, size + 1)[:size],
            out=sums[1:],
        )
        s, e = starts[at:upto] - base, ends[at:upto] - base
        out[at:upto] = (sums[e] - sums[s]) * _power_table(_INVERSE, size + 1)[s]
        at = upto
    return mix(out ^ ((ends - starts).astype(U64) << U64(48)))


def word_hashes(
    texts: pa.Array, gaps: np.ndarray = IS_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's words begin among them, and which texts are known."""
    raw, bounds, known = text_bytes(texts)
    starts, ends, first = word_spans(raw, bounds, gaps)
    return hash_spans(raw, starts, ends), first, known


def window_hashes(hashes: np.ndarray, offsets: list[int], salt: int) -> np.ndarray:
    """For each position, a hash of the items at position + offset; the last positions, where an
    offset would leave the array, are missing from the result."""
    span = max(offsets) + 1
    n = max(0, len(hashes) - span + 1)
    total = np.zeros(n, U64)
    for offset, factor in zip(offsets, seeds(len(offsets), salt), strict=True):
        total += hashes[offset : offset + n] * factor
    return mix(total)
