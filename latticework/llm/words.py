"""Words of Arrow text columns as 64-bit hashes, computed by numpy over runs of whole texts.

A word is a maximal run of bytes other than the six ASCII white-space characters. Its hash is a polynomial
over a random table of bytes, taken from prefix sums, so that no Python code runs per word. Equal words
have equal hashes; unequal words collide with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(20_261_128)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_FACTORS = _RANDOM.integers(1, 2**62, 64, dtype=U64) * U64(2) + U64(1)
_BASE = 0x9E37_79B9_7F4A_7C15


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below ``size``."""
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, U64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=U64))
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5_D329_728E_A185)
    x = (x ^ (x >> U64(27))) * U64(0x81DA_DEF4_BC2D_D44D)
    return x ^ (x >> U64(33))


@dataclass
class Words:
    """The words of a run of texts: ``bounds[i]:bounds[i + 1]`` are those of text ``i`` of the run."""

    first: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    sums: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte spans of the run, white space included."""
        down = _powers(1 << max(10, len(self.sums).bit_length()))[1]
        return mixed((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(U64))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def owners(self) -> np.ndarray:
        """The text each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)), offsets


def runs(texts: pa.Array | pa.ChunkedArray, folded: bool = True, run_bytes: int = RUN_BYTES) -> Iterator[Words]:
    """The words of every text, run by run; null texts count as empty. ``folded`` takes A-Z as a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    data, offsets = _buffers(texts)
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + run_bytes, "right")) - 1)
        yield _words(at, data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], folded)
        at = stop


def _words(first: int, data: np.ndarray, offsets: np.ndarray, folded: bool) -> Words:
    inside = ~_SPACE[data]
    edge = np.ones(len(data) + 1, bool)  # a word may start here because a space or a text border comes before
    edge[1:-1] = ~inside[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(inside & edge[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = ~inside
    after[offsets] = True
    ends = np.flatnonzero(inside & after[1:]) + 1
    up, down = _powers(1 << max(10, (len(data) + 1).bit_length()))
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((_FOLDED if folded else _BYTES)[data] * up[: len(data)], out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts])
    return Words(first, data, offsets, starts, ends, np.searchsorted(starts, offsets), hashes, sums)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """``sequence_hash`` of the ``n`` words from each word on, past the ends of texts too."""
    total = len(hashes)
    out = np.full(total, (n * int(_FACTORS[-1])) % 2**64, U64)
    for j in range(min(n, total)):
        out[: total - j] += hashes[j:] * _FACTORS[j]
    return mixed(out)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, whole)`` of the ``n``-word window at each word; ``whole`` is false where the text ends earlier."""
    last = np.repeat(words.bounds[1:], words.counts)
    return window_hashes(words.hashes, n), np.arange(len(last)) + n <= last


def sequence_hash(hashes: np.ndarray) -> int:
    """One hash of a word sequence of at most 63 words; its length is part of it."""
    terms = np.append(hashes * _FACTORS[: len(hashes)], np.array([len(hashes)], U64) * _FACTORS[-1])
    return int(mixed(terms.sum(dtype=U64, keepdims=True))[0])


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Sorted distinct ``n``-word shingles per text: a shorter text is one shingle, a text without words has none."""
    hashes, whole = grams(words, n)
    out = []
    for start, stop in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
        if stop - start >= n:
            out.append(np.unique(hashes[start : stop - n + 1]))
        elif stop > start:
            out.append(np.array([sequence_hash(words.hashes[start:stop])], U64))
        else:
            out.append(np.zeros(0, U64))
    return out
