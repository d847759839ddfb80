"""Words of whole texts as 64-bit numbers, for operators on word sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers from a fixed seed, one per place in a sequence.
_PLACES = np.random.default_rng(20240229).integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers, by a sort: ``np.unique`` hashes, which takes several times as long."""
    if not len(x):
        return x
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def split(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in one array, and the bounds of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, bounds = lists.flatten(), lists.offsets.to_numpy()
    bounds = bounds - bounds[0]
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[bounds]


def hashed(flat: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit number for each word; each distinct word is hashed once."""
    coded = flat.dictionary_encode()
    numbers = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return numbers[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)


def sequences(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A number for the ``n`` words from each position on (positions without ``n`` left get one too
    few: the result has ``len(words) - n + 1`` rows, or none)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(m, np.uint64)
        for j in range(n):
            total += words[j : j + m] * _PLACES[j]
        return mix(total, seed + n)


def shingles(words: np.ndarray, bounds: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct ``n``-word shingles of each text, flat, and their bounds. A text of fewer words
    has its whole sequence as its only one, an empty text none."""
    every, sizes, sets = sequences(words, n), np.diff(bounds), []
    short = {k: sequences(words, k) for k in np.unique(sizes[(sizes > 0) & (sizes < n)]).tolist()}
    for a, k in zip(bounds[:-1].tolist(), sizes.tolist(), strict=True):
        if k >= n:
            sets.append(distinct(every[a : a + k - n + 1]))
        else:
            sets.append(short[k][a : a + 1] if k else np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
