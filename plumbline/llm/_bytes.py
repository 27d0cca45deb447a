"""Words of whole texts by numpy, on the UTF-8 bytes that Arrow hands over.

A block holds whole texts of about BLOCK bytes, or one longer text, so that the temporary arrays stay a small
multiple of the longest text. No text is cut short; parts() takes a long one in stretches, for what adds up over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 19
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 .. n-1 of the hash's base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 1)
        up, down = np.full(size, _BASE, U), np.full(size, _INVERSE, U)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if n > BLOCK + 1:  # for this one text only
            return up[:n], down[:n]
        _powers.update(up=up, down=down)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all of its bits."""
    h = (h ^ (h >> U(31))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offset of each row and the end) of blocks of whole texts; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + BLOCK, "right")) - 1)
        yield lo, hi, whole[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """data in stretches of about BLOCK bytes that begin and end beside a space or line break, where there is one."""
    lo = 0
    while lo < len(data):
        hi = lo + BLOCK
        while hi < len(data):
            gap = np.flatnonzero((data[hi : hi + BLOCK] == 32) | (data[hi : hi + BLOCK] == 10))
            if len(gap):
                hi += int(gap[0])
                break
            hi += BLOCK
        yield data[lo:hi]
        lo = hi


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are inside; no run crosses from one text into the next."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[at] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def owner(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The row, counted from the block's first, that holds each position."""
    return np.searchsorted(at, start, "right") - 1


def sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte times power, with a zero before: hashes of any stretches come from these at once."""
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0], out=out[1:])
    return out


def stretch(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes start .. end of each stretch, the same wherever they stand."""
    return mix((total[end] - total[start]) * powers(len(total))[1][start])


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the two-byte capitals of Latin-1, in a copy."""
    out = data | np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    if len(out) > 1:
        lead = data[:-1] == 0xC3
        high = lead & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:] |= np.where(high, np.uint8(32), np.uint8(0))
    return out


def tail(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of values that each text owns: values are ordered by text, at has where each one's begin, and the end."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0)
    return out
