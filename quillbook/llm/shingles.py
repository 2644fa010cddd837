"""Word and shingle hashes of many texts at once, in numpy. Equal word sequences have equal hashes on every executor."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_P, -1, 1 << 64)
#: Texts are taken together up to so many bytes; a longer text is taken alone.
CHUNK = 2_000_000


def mix(z: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
        return z ^ (z >> _U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_P))
    _PLACE = mix(np.arange(1, 65, dtype=np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _INVERSE)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def chunks(texts: list[bytes], size: int = CHUNK):
    """(first, end) of stretches of texts of about `size` bytes at most."""
    at, total = 0, 0
    for k, t in enumerate(texts):
        if k > at and total + len(t) > size:
            yield at, k
            at, total = k, 0
        total += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined as bytes; the start and end of each word there; the number of its text."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    return joined, starts, ends, np.searchsorted(begins, starts, side="right") - 1


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash (uint64) and text number of each word, in order."""
    joined, starts, ends, doc = word_places(texts)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    up, down = powers(len(joined) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_BYTE[joined] * up[:-1], dtype=np.uint64)))
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), doc


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words."""
    m = max(0, len(words) - n + 1)
    out = np.zeros(m, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out += words[k : k + m] * _PLACE[k]
    return mix(out)


def shingle_sets(texts: list[bytes], n: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of n words, sorted within each text: hashes, text numbers, counts. A text of fewer words is one
    shingle; one without words has none."""
    words, doc = word_hashes(texts)
    h = window_hashes(words, n)
    whole = doc[: len(h)] == doc[n - 1 :] if len(h) else np.zeros(0, dtype=bool)
    hashes, owner = h[whole], doc[: len(h)][whole]
    size = np.bincount(doc, minlength=len(texts))
    few = np.flatnonzero((size > 0) & (size < n))
    if len(few):
        first = np.cumsum(size) - size
        short = [mix(np.sum(words[first[d] : first[d] + size[d]] * _PLACE[: size[d]], keepdims=True) + _U(size[d])) for d in few]
        hashes, owner = np.concatenate([hashes, *short]), np.concatenate([owner, few])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), dtype=bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return hashes[at], owner[at], np.diff(np.append(at, len(hashes)))
