"""Content-defined anchors: places that any two equal windows of bytes have in common.

Of the k-grams in each window of ``window`` bytes the one with the smallest hash is an anchor. Equal
windows choose the same one, so equal windows meet where their anchors' hashes are grouped, however
far apart the texts stand. A few percent of all places are anchors, whatever the texts.
"""

from __future__ import annotations

import functools

import numpy as np

GRAM = 32
#: Bytes hashed at once: a few arrays of eight bytes for each are held.
PIECE = 1 << 19
PLACE_BITS = 23
PLACE_MASK = np.uint64((1 << PLACE_BITS) - 1)


@functools.lru_cache(maxsize=2)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """2^bits powers of an odd base and of its inverse, modulo 2^64, and a random word for each byte."""
    base = 0x9E3779B97F4A7C15
    n = 1 << bits
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return powers(max(20, int(n).bit_length()))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def prefix(data: np.ndarray) -> np.ndarray:
    up, _, word = powers_for(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(word[data] * up[: len(data)], out=out[1:])
    return out


def between(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The hashes of data[start:end], the same wherever the bytes stand."""
    return mix((sums[end] - sums[start]) * powers_for(len(sums))[1][start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i:i+w]) for every i that fits."""
    n = len(x) - w + 1
    blocks = -(-len(x) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, end_of: np.ndarray, sums: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, and for each the first and the last start of the windows that choose it. end_of: for each byte, where its text ends."""
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(len(data) - GRAM + 1)
    keys = (between(sums, at, at + GRAM) & ~PLACE_MASK) | at.astype(np.uint64)
    chosen = (sliding_min(keys, window - GRAM + 1) & PLACE_MASK).astype(np.int64)
    start = np.flatnonzero(np.arange(len(chosen)) + window <= end_of[: len(chosen)])
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    chosen = chosen[start]
    first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (np.diff(start) != 1)])
    last = np.r_[first[1:], len(start)] - 1
    return chosen[first], start[first], start[last]


def pieces(lengths: list[int], window: int):
    """(first text, one past the last) of runs of whole texts of about PIECE bytes; a longer text stands alone."""
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if total and total + n > PIECE:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


def contexts(texts: list[bytes], window: int):
    """For the anchors of a batch of texts: arrays text, begin, length, hash, context hash.

    The context text[begin : begin + length] is made of the windows that choose the anchor.
    """
    lengths = [len(t) for t in texts]
    for first, last in pieces(lengths, window):
        alone = last - first == 1
        if alone and lengths[first] > PIECE:  # a part's windows start in [a, a + PIECE)
            parts = ((a, texts[first][a : a + PIECE + window - 1]) for a in range(0, lengths[first] - window + 1, PIECE))
        else:
            parts = ((0, b"".join(texts[first:last])) for _ in (0,))
        for shift, joined in parts:
            data = np.frombuffer(joined, np.uint8)
            size = np.array([len(data)]) if alone else np.array(lengths[first:last])
            ends = np.cumsum(size)
            end_of, start_of, which = np.repeat(ends, size), np.repeat(ends - size, size), np.repeat(np.arange(first, last), size)
            sums = prefix(data)
            p, lo, hi = anchors(data, end_of, sums, window)
            if not len(p):
                continue
            hi = hi + window
            key = between(sums, p, p + GRAM)
            context = mix(between(sums, lo, hi) ^ mix((p - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (hi - p).astype(np.uint64)))
            yield which[p], lo - start_of[p] + shift, hi - lo, key.view(np.int64), context.view(np.int64)
