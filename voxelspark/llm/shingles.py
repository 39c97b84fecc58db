"""Word shingles of whole texts as sorted arrays of 64-bit hashes, for whole Arrow columns at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Odd multipliers and a seed, arbitrary but the same in every process.
BASE = 0x9E3779B97F4A7C15
STEPS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
SEED = 20_240_229

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
BYTE = np.random.default_rng(SEED).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts are hashed together until they have this many bytes; a longer one is hashed part by part.
SLICE = 1 << 19

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse. Those that a slice needs are kept."""
    if n in range(1, 2 * SLICE + 1) and "up" in _powers:
        return _powers["up"], _powers["down"]
    size, out = max(n, 2 * SLICE), {}
    for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out[name] = np.multiply.accumulate(x)
    if size == 2 * SLICE:
        _powers.update(out)
    return out["up"], out["down"]


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts data[starts[i]:ends[i]] (adjacent), and the text's number for each word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(data) > 2 * SLICE and len(starts) == 1:
        parts, a = [], 0
        while a < len(data):
            b = min(a + SLICE, len(data))
            while b < len(data) and not SPACE[data[b]]:  # a word stays whole
                b += 1
            parts.append(_words(data[a:b], np.zeros(1, np.int64), np.array([b - a]))[0])
            a = b
        h = np.concatenate(parts)
        return h, np.zeros(len(h), np.int64)
    return _words(data, starts, ends)


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = ends > starts
    first[starts[full]] = ~space[starts[full]]
    last[ends[full] - 1] = ~space[ends[full] - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=total[1:])
    h = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(starts, a, side="right") - 1


def slices(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, starts, ends) of groups of neighbouring texts; null is the empty text."""
    text = pc.fill_null(text.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(text):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, side="right")) - 1)
        own = offsets[i : j + 1] - offsets[i]
        yield i, data[offsets[i] : offsets[j]], own[:-1], own[1:]
        i = j


def shingle_sets(text: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the sets of the texts, and their sorted distinct shingle hashes, one set after the other.

    Only A-Z are lower-cased. A text of fewer than `width` words, but some, has one shingle: all its words.
    """
    sizes, keys = np.zeros(len(text), np.int64), []
    for i, data, starts, ends in slices(text):
        h, of = words(LOWER[data], starts, ends)
        n_words = np.bincount(of, minlength=len(starts))
        n = max(0, len(h) - width + 1)
        joint = np.zeros(n, np.uint64)
        for k in range(width):
            joint += h[k : k + n] * np.uint64(STEPS[k % 4]) + np.uint64(k)
            joint = mix(joint)
        inside = of[:n] == of[width - 1 :] if n else np.zeros(0, bool)
        joint, own = joint[inside], of[:n][inside]
        short = np.flatnonzero((n_words > 0) & (n_words < width))
        if len(short):
            at = np.searchsorted(of, short)
            whole = np.zeros(len(short), np.uint64)
            for k in range(width - 1):
                there = n_words[short] > k
                whole[there] = mix(whole[there] + h[at[there] + k] * np.uint64(STEPS[k % 4]) + np.uint64(101 + k))
            joint, own = np.concatenate([joint, whole]), np.concatenate([own, short])
            order = np.argsort(own, kind="stable")
            joint, own = joint[order], own[order]
        edges = np.searchsorted(own, np.arange(len(starts) + 1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            joint[a:b].sort()
        new = np.ones(len(joint), bool)
        new[1:] = (joint[1:] != joint[:-1]) | (own[1:] != own[:-1])
        keys.append(joint[new])
        sizes[i : i + len(starts)] = np.bincount(own[new], minlength=len(starts))
    return sizes, np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums (modulo 2**64) of consecutive runs of the given sizes."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]
