"""Statistics of one text, from its bytes; vectorised within the text. Used inside Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
#: Character classes of a byte: lower, upper, digit, space, sentence marks, other ASCII marks, beyond ASCII.
CLASSES = ("lower", "upper", "digit", "space", "stop", "mark", "wide")
_CLASS = np.full(256, 5, dtype=np.int64)
_CLASS[128:] = 6
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*SPACE]] = 3
_CLASS[[*b".,;:'\"?()-"]] = 4


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of all runs of `width` words, given their hashes; empty when there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    x = h[:n].copy()
    for j in range(1, width):
        x = mixed(x) * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    return mixed(x)


def char_classes(b: bytes) -> np.ndarray:
    return np.bincount(_CLASS[np.frombuffer(b, np.uint8)], minlength=len(CLASSES))


def repeated_words(h: np.ndarray, width: int = 3) -> int:
    """Words covered by windows that occur twice or more."""
    w = windows(h, width)
    if not len(w):
        return 0
    _, back, n = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(n[back] > 1)
    hit = np.zeros(len(h), bool)
    for j in range(width):
        hit[at + j] = True
    return int(hit.sum())


def duplicate_lines(b: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
    return len(lines), len(lines) - len(set(lines))


def base_stats(text: str, b: bytes, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars (code points), n_symbols, n_dup_lines, n_repeat_words."""
    spaces = len(b) - len(b.translate(None, SPACE))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    return len(words), len(text) - spaces, symbols, duplicate_lines(b)[1], repeated_words(h)
