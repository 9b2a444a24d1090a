"""Sets of word shingles as 64-bit hashes, in numpy.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lowered. A text's set has its distinct runs of
`k` words; with fewer words, the whole sequence is one shingle; without words the set is empty.
A word hashes by its bytes (xxh3), a shingle by its words' hashes and places: two different
shingles meet with a chance of 2 ** -64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .common import own_texts

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a permutation of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' word hashes in a row, and where each text starts (and the end)."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(own_texts(texts)))
    coded = cut.flatten().dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    which = coded.indices.to_numpy()
    real = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[which] if len(which) else np.zeros(0, bool)
    bounds = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    return table[which[real]], np.concatenate([[0], np.cumsum(real)])[bounds]


def shingle_sets(texts: pa.Array, k: int = 5) -> list[np.ndarray]:
    """Each text's set as sorted distinct hashes."""
    words, bounds = word_hashes(texts)
    n = len(words) - k + 1
    if n > 0:
        h = words[:n].copy()
        for j in range(1, k):
            h = h * _ODD + words[j : j + n]
        h = mix(h)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            one = np.uint64(b - a)
            for x in words[a:b]:
                one = np.uint64((int(one) * int(_ODD) + int(x)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([one], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: equal sets agree, others meet with a chance of 2 ** -128."""
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
