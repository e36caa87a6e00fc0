"""Words and word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: White space between words as blanks, A-Z as a-z; no byte of another character is among them in UTF-8.
_PLAIN = bytes(32 if i in (32, *range(9, 14)) else i + 32 if 65 <= i <= 90 else i for i in range(256))
#: The first n bytes of a word's eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes of a word, beyond which it is hashed on its own.
_LONG = 64


def word_hashes(text: str | None) -> np.ndarray:
    """A hash a word, A-Z read as a-z; of all words at once, eight bytes of each at a time."""
    raw = b" " + (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN) + b" " * 8
    gap = np.frombuffer(raw, np.uint8) == 32
    edges = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # from each byte on
    out = mixed((eight[starts] & _FIRST[np.minimum(sizes, 8)]) * np.uint64(0x9E3779B97F4A7C15) + sizes.astype(np.uint64))
    for low in range(8, _LONG, 8):
        rest = np.flatnonzero(sizes > low)
        if not len(rest):
            return out
        own = eight[starts[rest] + low] & _FIRST[np.minimum(sizes[rest] - low, 8)]
        out[rest] = mixed((out[rest] ^ own) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(low))
    for k in np.flatnonzero(sizes > _LONG):
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : starts[k] + sizes[k]])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row; one for all if there are fewer, none if there are none."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - size + 1 + i])
    return out


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(windows(word_hashes(text), k))
