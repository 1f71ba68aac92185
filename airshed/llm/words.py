"""Byte-level word helpers used inside tasks.

Texts arrive as UTF-8 bytes (an Arrow string column viewed as binary), so a
word split is one ``bytes.translate`` and one ``bytes.split``; both only look
at ASCII bytes and never cut a multi-byte character.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np

# bytes.split() without arguments cuts at exactly [\x20\x09-\x0D]
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# letters (lower-cased), digits and every non-ASCII byte stay, the rest is a gap
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
               for c in range(256))

_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def alnum_bytes(text: bytes) -> bytes:
    """Lower-cased text with every ASCII byte but letters and digits blanked."""
    return text.translate(_ALNUM)


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(_ALNUM).split()


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def word_codes(words: list[bytes]) -> np.ndarray:
    """A stable 64-bit code per word (equal in every process)."""
    n = len(words)
    lo = np.fromiter(map(crc32, words), np.uint64, n)
    size = np.fromiter(map(len, words), np.uint64, n)
    return mix(lo + (size << np.uint64(32)) + _M1)


def kmer_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A code per run of ``k`` words; fewer than ``k`` words are one run."""
    if not len(codes):
        return codes
    k = min(k, len(codes))
    out = np.zeros(len(codes) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = mix(out * _M1 + codes[j:j + len(out)])
    return out


def occurrence(codes: np.ndarray) -> np.ndarray:
    """0 for the first time a code occurs, 1 for the second, and so on."""
    order = np.argsort(codes, kind="stable")
    run = codes[order]
    new = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    at = np.arange(len(run))
    start = np.maximum.accumulate(np.where(new, at, 0)) if len(run) else at
    out = np.empty(len(run), np.uint64)
    out[order] = (at - start).astype(np.uint64)
    return out
