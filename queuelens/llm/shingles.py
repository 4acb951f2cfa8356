"""Word and shingle hashes inside tasks (numpy)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Word hashes remembered per worker; the cache starts anew when it is full.
CACHE_WORDS = 200_000
_HASHES: dict[bytes, int] = {}
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, in order."""
    if len(_HASHES) > CACHE_WORDS:
        _HASHES.clear()
    for w in set(words).difference(_HASHES):
        _HASHES[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of a text with A-Z
    lower-cased; a shorter text is one shingle; without words there is none."""
    words = (text or "").encode().lower().split()      # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix64(total * _STEP + h[k:len(h) - n + 1 + k])
    return np.unique(total)


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """``shingle_set`` of every text of a batch; each different word is hashed once."""
    plain = pc.fill_null(texts, "").cast(pa.large_string())
    for gap in "\t\n\x0b\x0c\r":
        plain = pc.replace_substring(plain, gap, " ")
    lists = pc.split_pattern(pc.ascii_lower(plain), " ")    # lower-cased last: Arrow does it wrongly on slices
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(real)])
    edges = upto[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
    words = flat.filter(pa.array(real)).dictionary_encode()
    known = np.fromiter((xxhash.xxh64_intdigest(w) for w in words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h = known[words.indices.to_numpy()]
    n = max(len(h) - width + 1, 0)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total = mix64(total * _STEP + h[k:n + k])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(total[a:b - width + 1]))
        elif a == b:
            out.append(np.empty(0, np.uint64))
        else:                       # fewer words than a shingle: all of them
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = mix64(one * _STEP + h[k:k + 1])
            out.append(one)
    return out


def set_key(hashes: np.ndarray) -> bytes:
    """128-bit key of a set of hashes."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def portions(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about ``most`` bytes together, with the number of the first."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of few rows, which bounds what a task unpacks at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
