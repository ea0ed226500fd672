"""Word hashes, five-word shingles and MinHash signatures, vectorised over batches of texts."""

from __future__ import annotations

import hashlib

import numpy as np

WORDS = 5
PIECE = 1 << 20
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalising steps of a 64-bit mixer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _stream(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(seed))


IS_WORD = np.zeros(256, bool)
IS_WORD[[*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)]] = True
BYTE_VALUES = _stream(11, 256)
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
POSITION = _stream(23, WORDS) | U(1)


def _hash_piece(piece: np.ndarray) -> np.ndarray:
    """Hashes of the words in bytes that begin and end with whole words: polynomial sums, shifted to a common origin."""
    flags = np.zeros(len(piece) + 2, np.int8)
    flags[1:-1] = IS_WORD[piece]
    steps = np.diff(flags)
    start, end = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    powers = np.full(len(piece), BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[piece] * powers)])
    back = np.full(len(piece), BASE_INVERSE, dtype=np.uint64)
    back[0] = 1
    back = np.cumprod(back)
    return mixed((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the text's lower-cased words, in order."""
    data = np.frombuffer(text.lower().encode(), dtype=np.uint8)
    if len(data) <= PIECE:
        return _hash_piece(data)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and IS_WORD[data[end]] and IS_WORD[data[end - 1]]:
            end += 1
        out.append(_hash_piece(data[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of every WORDS consecutive words; of all words where there are fewer."""
    words = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(words):
        return words
    width = min(WORDS, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        total = total + words[j : len(words) - width + 1 + j] * POSITION[j]
    return np.unique(mixed(total))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.sha256(shingles.tobytes()).digest()[:16]


class MinHash:
    """Signatures of `size` 16-bit values; two sets agree in a value with the probability of their similarity."""

    def __init__(self, size: int, seed: int = 77):
        self.multiply = _stream(seed, size) | U(1)
        self.add = _stream(seed + 1, size)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each set (none of them empty)."""
        flat = np.concatenate(sets)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
        out = np.empty((len(sets), len(self.multiply)), dtype=np.uint16)
        for k in range(len(self.multiply)):
            least = np.minimum.reduceat(flat * self.multiply[k] + self.add[k], starts)
            out[:, k] = (mixed(least) >> U(48)).astype(np.uint16)
        return out
