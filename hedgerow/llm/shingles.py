"""Word shingles of texts, in arrays: words are lower-cased runs outside ASCII white space, hashed without a loop over them."""

from __future__ import annotations

import hashlib

import numpy as np

from .bpe import inverse, power_at, powers

_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit hangs on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words in each text) of lower-cased UTF-8 texts."""
    raw = b" ".join([*texts, b""])  # a blank between texts, so that no word crosses
    data = np.frombuffer(raw, np.uint8)
    space = ((data >= 9) & (data <= 13)) | (data == 32)
    solid = np.concatenate([[False], ~space, [False]])
    begin = np.flatnonzero(solid[1:-1] & ~solid[:-2])
    end = np.flatnonzero(solid[1:-1] & ~solid[2:]) + 1
    base = 0xD6E8FEB86659FD93
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(0x1B873593)) * powers(base, len(data)), out=total[1:])
    hashes = mixed((total[end] - total[begin]) * power_at(inverse(base), begin))
    edges = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, edges), prepend=0)
    return hashes, counts


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, times) of the distinct shingles of each text, by text and shingle.

    A text with fewer words than ``width`` has one shingle of all its words; one without words has none.
    """
    words, counts = word_hashes(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = max(len(words) - width + 1, 0)
    full = owner[:n] == owner[width - 1 :] if n else np.zeros(0, bool)
    value = np.zeros(n, np.uint64)
    for k in range(width):
        value = value * _STEP + words[k : k + n]
    doc, value = owner[:n][full], value[full]
    small = np.flatnonzero((counts > 0) & (counts < width))
    if len(small):
        first = np.cumsum(counts) - counts
        own = []
        for i in small.tolist():
            h = np.uint64(counts[i])
            for w in words[first[i] : first[i] + counts[i]]:
                h = np.uint64((int(h) * int(_STEP) + int(w)) % (1 << 64))
            own.append(h)
        doc, value = np.concatenate([doc, small]), np.concatenate([value, np.array(own, np.uint64)])
    value = mixed(value)
    order = np.argsort(value)
    order = order[np.argsort(doc[order].astype(np.min_scalar_type(len(texts))), kind="stable")]  # small numbers are sorted by their digits
    doc, value = doc[order], value[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(first)
    return doc[at], value[at], np.diff(np.append(at, len(doc)))


def lowered(texts: list) -> list[bytes]:
    return [(t or "").lower().encode() for t in texts]


def digest(text: bytes) -> bytes:
    """16 bytes of the text's word sequence."""
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()
