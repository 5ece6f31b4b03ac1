"""Vectorised word and shingle hashes over Arrow text buffers."""

from __future__ import annotations

import numpy as np

#: `[\x20\x09-\x0D]` separates words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WIDTH = 5
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))
_PLACE = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
#: Powers that a worker keeps (longer texts make their own).
KEPT = 5 << 18
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; the first KEPT are kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.full(max(n, KEPT), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if len(have) == KEPT:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the number of words before it (n + 1 offsets)."""
    inside = ~SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = np.flatnonzero(offs[1:] > offs[:-1])
    heads, tails = offs[full], offs[full + 1] - 1
    begins[heads] = inside[heads]
    ends[tails] = inside[tails]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z."""
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * powers(_STEP, len(data)), out=run[1:])
    h = (run[ends] - run[starts]) * powers(_BACK, len(data) + 1)[starts]
    return mix(h ^ (ends - starts).astype(np.uint64))


def shingle_hashes(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's shingles with repeats, and n + 1 offsets.

    Texts of fewer words than `width` have their whole sequence as one shingle;
    texts without words have none.
    """
    starts, ends, at = word_spans(data, offs)
    w = word_hashes(data, starts, ends)
    n = np.diff(at)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(n.dtype))
    out_at = np.concatenate([[0], np.cumsum(count)])
    if not len(w):
        return np.empty(0, np.uint64), out_at
    padded = np.concatenate([w, np.zeros(width, np.uint64)])
    whole = np.zeros(len(w), np.uint64)
    for k in range(width):
        whole += padded[k : k + len(w)] * _PLACE[k]
    first = np.arange(int(out_at[-1])) - np.repeat(out_at[:-1], count) + np.repeat(at[:-1], count)
    out = mix(whole[first])
    for i in np.flatnonzero((n > 0) & (n < width)):
        part = (w[at[i] : at[i + 1]] * _PLACE[: n[i]]).sum(dtype=np.uint64, keepdims=True)
        out[out_at[i]] = mix(part + _PLACE[8 + n[i] : 9 + n[i]])[0]
    return out, out_at


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Every text's distinct shingle hashes, ascending."""
    h, at = shingle_hashes(data, offs, width)
    return [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
