"""Vectorised word shingles.

A whole Arrow batch of texts is hashed at once: words are found on the byte
buffer, hashed by a multilinear hash (a random 64-bit value per byte times a
random odd factor per place in the word) and combined four at a time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on whole arrays."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE = mix64(np.arange(1000, 1256, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_PLACE = _factors(1 << 12)
_WORD = _factors(1 << 6)[50:]
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_LOWER = np.arange(256, dtype=np.uint8) + (np.isin(np.arange(256), np.arange(65, 91)) * 32).astype(np.uint8)

#: Bytes that are hashed at once: some 40 bytes of memory are taken for each.
STRETCH = 1 << 18


def _at_place(place: np.ndarray) -> np.ndarray:
    """The factor of each place in a word; those of very long words aren't kept."""
    if not len(place) or place.max() < len(_PLACE):
        return _PLACE[place]
    return mix64((place.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)) | _U(1)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives its free memory back at the end: a worker
    lives on, and would keep what its largest task took."""

    @wraps(run)
    def inner(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return inner


def slices(batch: pa.RecordBatch, most: int = 2_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``most`` bytes of text; a longer text is a part alone."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a batch; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, and
    the offset of each text's first word (one more offset than texts). Bytes are
    read in stretches; a word that goes on in the next one adds to its sum."""
    raw, off = _buffer(texts)
    places, sums, sizes, open_ = [], [], [], False
    for a in range(0, len(raw), STRETCH):
        part = raw[a : a + STRETCH]
        inside = ~_SPACE[part]
        new = inside.copy()
        new[1:] &= ~inside[:-1]
        new[0] &= not open_
        heads = off[np.searchsorted(off, a) : np.searchsorted(off, a + len(part))] - a
        new[heads] = inside[heads]
        at, goes_on = np.flatnonzero(new), bool(inside[0] and not new[0])
        open_ = bool(inside[-1])
        if goes_on:
            at = np.append(0, at)
        if not len(at):
            continue
        data = _LOWER[part[inside]]
        begin = np.cumsum(inside, dtype=np.int32)[at] - 1
        size = np.diff(np.append(begin, len(data)))
        place = np.arange(len(data)) - np.repeat(begin, size)
        if goes_on:
            place[: size[0]] += sizes[-1][-1]
        total = np.add.reduceat(_BYTE[data] * _at_place(place), begin)
        if goes_on:
            sums[-1][-1:] += total[:1]
            sizes[-1][-1:] += size[:1]
            at, total, size = at[1:], total[1:], size[1:]
        if len(at):
            places.append(at + a)
            sums.append(total)
            sizes.append(size)
    if not places:
        return np.zeros(0, _U), np.zeros(len(off), np.int64)
    return mix64(np.concatenate(sums) + np.concatenate(sizes).astype(_U)), np.searchsorted(np.concatenate(places), off)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. A text of fewer than
    ``width`` words has its whole sequence as one shingle; one without words
    has none."""
    words, off = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(max(0, n - width + 1), _U)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _WORD[k]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * _WORD[: b - a]).sum(dtype=_U) + _U(b - a)
            out.append(mix64(np.array([short], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out
