"""Words of whole texts as 64-bit hashes, vectorised over Arrow batches.

A word's hash is a polynomial in its bytes modulo 2^64, mixed; sums over a prefix of the batch give
every word at once, so no Python object per word exists.  Modulo a power of two such polynomials agree for
some long, regular pairs of words, so words above ``LONG`` bytes get 64 bits of BLAKE2b instead.  Texts are worked on in pieces of about
``CHUNK`` bytes cut between texts, or at white space inside a longer text: memory is bounded by the
piece, and nothing of a text is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK = 500_000
LONG = 32
_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)


def release() -> None:
    """Give the memory of finished batches back; the worker process stays for later tasks."""
    pa.default_memory_pool().release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; every input bit reaches every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_STEP))[_LOWER]  # A-Z count as a-z
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        grow = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64))])
        _powers = grow(_U(_STEP)), grow(_U(_BACK))
    return _powers


def _hash_piece(data: np.ndarray, bounds: np.ndarray, heads: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the texts ``data[bounds[i]:bounds[i + 1]]`` and where each text's words start.

    With ``heads`` the hashes have further rows, for the first so many bytes of each word.
    """
    if not len(data):
        return np.empty((1 + len(heads), 0) if heads else 0, np.uint64), np.zeros(len(bounds), np.int64)
    word = ~_SPACE[data]
    before, after = np.empty_like(word), np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    after[-1], after[:-1] = False, word[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]
    before[edges], after[edges - 1] = False, False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
    up, down = _power(max(len(data), CHUNK))
    total = np.cumsum(_BYTE[data] * up[: len(data)])
    lead = np.where(starts > 0, total[starts - 1], _U(0)) if len(starts) else total[:0]
    hashes = mix((total[ends] - lead) * down[starts])
    for i in np.flatnonzero(ends - starts >= LONG).tolist():
        lowered = _LOWER[data[starts[i] : ends[i] + 1]].tobytes()
        hashes[i] = int.from_bytes(blake2b(lowered, digest_size=8).digest(), "little")
    if heads:
        cut = [mix((total[np.minimum(ends, starts + h - 1)] - lead) * down[starts] + _U(h)) for h in heads]
        hashes = np.stack([hashes, *cut])
    return hashes, np.searchsorted(starts, bounds)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Cut one long text at white space into pieces of about CHUNK bytes."""
    at = 0
    while len(data) - at > CHUNK:
        size = CHUNK
        gaps = np.flatnonzero(_SPACE[data[at : at + size]])
        while not len(gaps) and at + size < len(data):  # a word longer than a piece
            gaps = np.flatnonzero(_SPACE[data[at + size : at + 2 * size]]) + size
            size *= 2
        if not len(gaps):
            break
        yield data[at : at + gaps[-1] + 1]
        at += int(gaps[-1]) + 1
    yield data[at:]


def hashed_words(texts: pa.Array, heads: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield ``(first text, word hashes, word bounds)`` for consecutive runs of texts; null is empty."""
    texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, raw = texts.buffers()
    n = len(texts)
    if not n:
        return
    at = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK, "right")) - 1)
        part = data[at[i] : at[j]]
        if j == i + 1 and len(part) > CHUNK:
            words = np.concatenate([_hash_piece(p, np.array([0, len(p)]), heads)[0] for p in _pieces(part)], axis=-1)
            yield i, words, np.array([0, words.shape[-1]])
        else:
            yield i, *_hash_piece(part, at[i : j + 1] - at[i], heads)
        i = j


_PLACE = mix(np.arange(101, 165, dtype=np.uint64) * _U(_STEP)) | _U(1)


def gram_hashes(words: np.ndarray, places: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at ``i + p`` for each ``p`` in ``places``, for every ``i`` where all exist."""
    n = len(words) - max(places)
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, _PLACE[len(places) + 32], np.uint64)
    for k, p in enumerate(places):
        total += words[p : p + n] * _PLACE[k]
    return mix(total)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its ``k``-word shingles; a shorter text is one shingle."""
    grams = gram_hashes(words, tuple(range(k)))
    sets = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            sets.append(gram_hashes(words[a:b], tuple(range(b - a))))
        else:
            sets.append(grams[:0])
    return sets
