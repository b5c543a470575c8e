"""Words of Arrow string columns as arrays: one hash for each word, computed over the bytes of a batch at once.

A word is a run of ASCII letters, digits and bytes above 0x7F of the lower-cased text; ASCII
punctuation, white space and the general punctuation block (U+2000 to U+206F) separate words.
Texts are walked in windows of a few MB, so memory is bounded by the window and the hashes of
one batch, not by the bytes of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WINDOW = 1 << 21
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    z = z ^ (z >> np.uint64(30))
    z = z * _M1
    z ^= z >> np.uint64(27)
    z *= _M2
    z ^= z >> np.uint64(31)
    return z


def _odd(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_BYTE, _PLACE, _GRAM = _odd(256, 1), _odd(256, 2), _odd(64, 3)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """hash: one per word; first: the index of each text's first word, and the number of words at the end."""

    hash: np.ndarray
    first: np.ndarray
    #: Byte offsets of each word in the flat lower-cased text.
    start: np.ndarray
    end: np.ndarray
    #: One row for each prefix length asked for: hashes of the words' first bytes.
    prefix: np.ndarray

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.lengths())


def flat(texts: pa.Array, lower: bool = True, ascii_lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts) of a string column; nulls are empty. ascii_lower: only A-Z are lower-cased."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pc.utf8_lower(texts) if lower and not ascii_lower else texts
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if ascii_lower:
        data, at = data[at[0] : at[-1]].copy(), at - at[0]
        data[(data >= 65) & (data <= 90)] += 32
    return data, at


def _cut(data: np.ndarray, lo: int, hi: int, end: int) -> int:
    """The end of a window that splits no word: `hi`, or a separator before it; or after it, if a word fills the window."""
    if hi >= end:
        return end
    gaps = np.flatnonzero(~_IS_WORD[data[max(lo, hi - 4096) : hi]])
    if len(gaps):
        return max(lo, hi - 4096) + int(gaps[-1]) + 1
    while hi < end and _IS_WORD[data[hi]]:
        hi += 1
    return hi


def _window(data: np.ndarray, at: np.ndarray, lo: int, hi: int, prefixes: tuple[int, ...], plain: bool) -> tuple[np.ndarray, ...]:
    part = data[lo:hi]
    word = _IS_WORD[part]
    dash = np.flatnonzero(part == 0xE2) if not plain else np.zeros(0, np.int64)
    dash = dash[dash + 2 < len(part)]
    dash = dash[(part[dash + 1] == 0x80) | (part[dash + 1] == 0x81)]
    for k in range(3):
        word[dash + k] = False
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    i, j = np.searchsorted(at, [lo, hi], side="left")
    inner = at[i:j] - lo
    inner = inner[inner < len(part)]
    begin[inner] |= word[inner]
    start = np.flatnonzero(begin)
    stop = np.ones(len(part) + 1, dtype=bool)
    stop[:-1] = ~word | begin
    ends = np.flatnonzero(stop)
    end = ends[np.searchsorted(ends, start, side="right")]
    size = end - start
    if not len(start):
        return np.zeros(0, np.uint64), start + lo, end + lo, np.zeros((len(prefixes), 0), np.uint64)
    letters = part[word]
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    value = _BYTE[letters] * _PLACE[place & 255]
    heads = np.zeros((len(prefixes), len(start)), np.uint64)
    if prefixes:
        upto = np.concatenate([[np.uint64(0)], np.cumsum(value)])
        for row, k in enumerate(prefixes):
            heads[row] = mix(upto[first + np.minimum(size, k)] - upto[first] + np.uint64(k))
    return mix(np.add.reduceat(value, first)), start + lo, end + lo, heads


def words(texts: pa.Array, prefixes: tuple[int, ...] = (), plain: bool = False) -> Words:
    """The words of every text of a column, with hashes of their prefixes of the given lengths in bytes.

    plain: only A-Z are lower-cased, and every character beyond ASCII belongs to a word.
    """
    data, at = flat(texts, ascii_lower=plain)
    lo, end, parts = int(at[0]), int(at[-1]), []
    while lo < end:
        hi = _cut(data, lo, lo + WINDOW, end)
        parts.append(_window(data, at, lo, hi, prefixes, plain))
        lo = hi
    none = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((len(prefixes), 0), np.uint64))]
    h, s, e, heads = (np.concatenate(x, axis=-1) for x in zip(*(parts or none)))
    return Words(h, np.searchsorted(s, at, side="left"), s, e, heads)


def gram_places(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and the index of the first word of each."""
    k = max(0, len(hashes) - n + 1)
    total = np.zeros(k, dtype=np.uint64)
    for j in range(n):
        total += hashes[j : j + k] * _GRAM[j]
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = np.flatnonzero(owner[:k] == owner[n - 1 : n - 1 + k])
    return mix(total[whole]), whole


def grams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a text, and the index of the text of each.

    With `short`, a text of fewer than n words (but one at least) has one run of all its words.
    """
    lengths = np.diff(first)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    k = max(0, len(hashes) - n + 1)
    total = np.zeros(k, dtype=np.uint64)
    for j in range(n):
        total += hashes[j : j + k] * _GRAM[j]
    whole = owner[:k] == owner[n - 1 : n - 1 + k]
    out, of = mix(total[whole]), owner[:k][whole]
    if short:
        few = np.flatnonzero((lengths > 0) & (lengths < n))
        if len(few):
            place = np.arange(len(hashes)) - np.repeat(first[:-1], lengths)
            inside = lengths[owner] < n
            value = hashes[inside] * _GRAM[place[inside]]
            begin = np.cumsum(lengths[few]) - lengths[few]
            out, of = np.concatenate([out, mix(np.add.reduceat(value, begin) + np.uint64(7))]), np.concatenate([of, few])
    return out, of


def batches(stream: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one take about `most` bytes, or are one text."""
    for batch in stream:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // most
        edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(sizes)]]) if len(sizes) else [0]
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield batch.slice(int(lo), int(hi - lo))
