"""Word hashes of many texts at once, in numpy.

A word is a run of ASCII letters and digits (lower-cased) and of bytes of non-ASCII characters. Its
hash is a polynomial of its bytes modulo 2**64, mixed; it is the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_MULT = np.uint64(0x9E3779B97F4A7C15)
_SEP = 10

_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _MULT, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: list[str | None], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each text). With prefixes: a column for the words and one for each length of
    prefix, in bytes (of shorter words: the word)."""
    encoded = [t.lower().encode("utf-8", "replace") if t else b"" for t in texts]
    none = np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64)
    if not encoded:
        return none, np.zeros(0, np.int64)
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    word = _IS_WORD[data]
    edge = np.flatnonzero(np.diff(word, prepend=False))
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0] + [len(e) + 1 for e in encoded])
    counts = np.diff(np.searchsorted(starts, begins))
    if not len(starts):
        return none, counts
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    value = (data[word].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    whole = mix(np.add.reduceat(value, first))
    if not prefixes:
        return whole, counts
    parts = [mix(np.add.reduceat(np.where(place < k, value, np.uint64(0)), first) + np.uint64(k)) for k in prefixes]
    return np.stack([whole, *parts], axis=1), counts


def word_hash_groups(texts: list[str | None], prefixes: tuple[int, ...] = (), most: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """word_hashes of consecutive texts of at most about so many characters together, with the position of each group's first text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t or "") > most:
            yield first, *word_hashes(texts[first:i], prefixes)
            first, size = i, 0
        size += len(t or "")
    if first < len(texts):
        yield first, *word_hashes(texts[first:], prefixes)


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """XXH64 of each run of width words (fewer words: of all of them; none: no hash), A-Z lower-cased; words end at ASCII white space."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    line, h = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words)
    if n <= width:
        return np.array([h(line, seed)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    starts = np.cumsum(lengths + 1) - lengths - 1
    ends = (starts + lengths)[width - 1 :].tolist()
    return np.array([h(line[s:e], seed) for s, e in zip(starts[: n - width + 1].tolist(), ends, strict=True)], np.uint64)
