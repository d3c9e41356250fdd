"""Vectorised words and hashes over UTF-8 bytes (NumPy), used inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_M64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes hashed at once; only a single longer word makes a longer piece.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; `x` is left as it is."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i (mod 2^64) for i < n or more."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, PIECE + 4096)
        up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes, one longer than `data`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], wherever it stands, from `prefix` sums."""
    h = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(texts: list[bytes], heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts in order (A-Z lower-cased, split at 0x20 and 0x09-0x0D), and where each text's words begin (one longer than texts). With `heads`, each word's row also has the hashes of its first bytes, so many as said."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.cumsum(sizes)))
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        gap = _SEPARATOR[data[at:end]]
        if end < len(data) and not gap[-1]:
            back = np.flatnonzero(gap)
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                while end < len(data) and not _SEPARATOR[data[end]]:
                    end += 1
                end = min(end + 1, len(data))
            gap = _SEPARATOR[data[at:end]]
        edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(s):
            sums = prefix(_LOWER[data[at:end]])
            h = span_hash(sums, s, e)
            hashes.append(np.column_stack([h, *(span_hash(sums, s, np.minimum(s + k, e)) + np.uint64(k) for k in heads)]) if heads else h)
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros((0, 1 + len(heads)) if heads else 0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), first)


def octets(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8; null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def portions(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut into runs of rows of about `most` bytes of text (one row at least), with the text."""
    for batch in batches:
        texts, a, held = octets(batch.column(column)), 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > most:
                yield batch.slice(a, i - a), texts[a:i]
                a, held = i, 0
            held += len(t) + 1
        if a < len(texts):
            yield batch.slice(a), texts[a:]


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of n-word shingles of one text's words, sorted; fewer words make one shingle of the whole sequence, no words none."""
    k = min(n, len(hashes))
    if not k:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - k + 1, k, np.uint64)
    for j in range(k):
        out *= np.uint64(0xA0761D6478BD642F)
        out += hashes[j : j + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))
