"""Word shingles as 64-bit hashes, computed on whole buffers."""

from __future__ import annotations

import numpy as np

from palimp.session import ship_by_value

ship_by_value(__name__)

U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 2**64)
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed in one go; a longer word is hashed whole all the same.
SLICE = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A number per byte, the same for A and a.
_BYTE = mixed(np.arange(1, 257, dtype=U) * U(_MULTIPLIER))
_BYTE[65:91] = _BYTE[97:123]
_powers = np.ones(1, dtype=U), np.ones(1, dtype=U)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        _powers = tuple(
            np.multiply.accumulate(np.concatenate([np.ones(1, dtype=U), np.full(n - 1, base, dtype=U)])) for base in (_MULTIPLIER, _INVERSE)
        )
    return _powers[0][:n], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash for each word, that is, each run of bytes between ASCII blanks, A-Z as a-z."""
    found, at = [], 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        data = np.frombuffer(text[at:end], dtype=np.uint8)
        at = end
        blank = np.concatenate([[True], _BLANK[data], [True]])
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = _powers_to(len(data))
        sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum(_BYTE[data] * up, dtype=U)])
        found.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U)))
    return np.concatenate(found) if found else np.zeros(0, dtype=U)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct shingles of ``words`` words; a shorter text is one shingle, a text without a word has none."""
    w = word_hashes(text)
    if not len(w):
        return w
    width = min(words, len(w))
    total = np.full(len(w) - width + 1, width, dtype=U)
    for i in range(width):
        total = mixed(total + w[i : len(w) - width + 1 + i])
    return np.unique(total)
