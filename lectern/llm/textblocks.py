"""Numpy kernels over blocks of whole texts.

A block is one contiguous byte buffer with document offsets, taken straight from an Arrow
string column. Nothing here knows about Spark; the operators call it inside ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            _powers[k] = np.multiply.accumulate(column)
    return _powers[0][:n], _powers[1][:n]


class Block:
    """Some rows of an Arrow batch: ``data`` holds the texts' bytes end to end, ``at`` the n + 1 offsets."""

    def __init__(self, data: np.ndarray, at: np.ndarray, first: int):
        self.data, self.at, self.first = data, at, first

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, k: int) -> bytes:
        return self.data[self.at[k] : self.at[k + 1]].tobytes()

    def prefix_hash(self) -> np.ndarray:
        """c with c[j] - c[i] a polynomial of the bytes from i to j, shifted by i."""
        up, _ = powers(len(self.data))
        c = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[self.data] * up, out=c[1:])
        return c

    def words(self, wordy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes for which ``wordy`` holds, and for each document the index of its first word (n + 1 values). Runs stop at document ends."""
        inside = wordy[self.data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = self.at[(self.at > 0) & (self.at < len(self.data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.at)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span; it depends on the span's content only."""
        c = self.prefix_hash()
        _, down = powers(len(self.data) + 1)
        return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Steps of a byte's place in its word.
_PLACE = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a scrambled value for each byte at its place, scrambled again with the length. Unlike a polynomial it has no structure that texts could meet by their order of letters."""
    out = np.zeros(len(starts), np.uint64)
    lengths = ends - starts
    total = np.concatenate([[0], np.cumsum(lengths)])
    first = 0
    while first < len(starts):  # some words, or one long one, at a time
        last = max(first + 1, int(np.searchsorted(total, total[first] + BLOCK_BYTES, "right")) - 1)
        at = total[first:last] - total[first]
        place = np.arange(total[last] - total[first]) - np.repeat(at, lengths[first:last])
        values = mix(BYTE_CODE[data[place + np.repeat(starts[first:last], lengths[first:last])]] + place.astype(np.uint64) * _PLACE)
        out[first:last] = np.add.reduceat(values, at)
        first = last
    return mix(out + lengths.astype(np.uint64))


def blocks(texts: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut an Arrow string column into blocks of about ``limit`` bytes; a longer text is a block of its own. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    if not len(texts):
        return
    texts = texts.cast(pa.large_binary())
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    k, n = 0, len(texts)
    while k < n:
        end = max(k + 1, int(np.searchsorted(at, at[k] + limit, "right")) - 1)
        yield Block(data[at[k] : at[end]], (at[k : end + 1] - at[k]).astype(np.int64), k)
        k = end


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z turned to a-z."""
    return _LOWER[data]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes that are not white space: words as [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles within documents, and each document's first shingle (n + 1 values). A document of fewer words, but not none, has its whole sequence as one."""
    counts = np.diff(first)
    per_doc = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    at = np.concatenate([[0], np.cumsum(per_doc)])
    doc = np.repeat(np.arange(len(counts)), per_doc)
    start = first[doc] + np.arange(at[-1]) - at[doc]
    out = np.zeros(len(start), np.uint64)
    left = first[doc + 1] - start
    for j in range(k):
        there = left > j
        step = h[np.minimum(start + j, max(len(h) - 1, 0))] if len(h) else out
        out = np.where(there, mix(out + step + np.uint64(j + 1)), out)
    return out, at
