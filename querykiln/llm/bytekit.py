"""Array kernels over the bytes of many texts at once: words, hashes, segments."""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240501))
#: A random number for each byte; a word's hash sums them, each times a power of its place.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
#: White space [\x20\x09-\x0D].
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        more = np.full(max(n, 2 * len(_POWERS)), _BASE)
        more[0] = 1
        _POWERS = np.multiply.accumulate(more)
    return _POWERS


def segment_hashes(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[s : s + n] for each segment; segments ascend and don't overlap."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = int(sizes.sum())
    first = np.zeros(len(sizes), np.int64)
    np.cumsum(sizes[:-1], out=first[1:])
    place = np.arange(total) - np.repeat(first, sizes)
    at = place + np.repeat(starts, sizes)
    value = _BYTE[buf[at]]
    value *= powers(int(sizes.max()))[place]
    return mixed(np.add.reduceat(value, first) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the runs of bytes that aren't white space."""
    out = ~IS_SPACE[buf]
    edge = np.diff(out.astype(np.int8), prepend=0, append=0)
    starts = np.flatnonzero(edge == 1)
    return starts, np.flatnonzero(edge == -1) - starts


class Words:
    """Words of a block of texts: hashes, and each text's range of words."""

    def __init__(self, texts: list, lower: bool):
        parts = [t.encode() if t else b"" for t in texts]
        raw = b"\n".join(parts) + b"\n"
        if lower:
            raw = raw.translate(LOWER_AZ)
        self.raw, self.buf = raw, np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        self.text_end = np.cumsum(sizes)
        self.text_start = self.text_end - sizes
        self.start, self.size = word_spans(self.buf)
        self.hash = segment_hashes(self.buf, self.start, self.size)
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingle hashes of each text, sorted, and each text's offsets.

    A text with fewer than k words has its whole sequence as its one shingle, one
    without words has none.
    """
    h, n = words.hash, len(words.hash)
    if n >= k:
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s = mixed(s + h[j : n - k + 1 + j])
    out, offsets = [], [0]
    for a, b in zip(words.first.tolist(), words.last.tolist()):
        if b - a >= k:
            got = np.unique(s[a : b - k + 1])
        elif b > a:
            one = np.array([b - a], np.uint64) * np.uint64(0xA24BAED4963EE407)
            for j in range(a, b):
                one = mixed(one + h[j])
            got = one
        else:
            got = np.zeros(0, np.uint64)
        out.append(got)
        offsets.append(offsets[-1] + len(got))
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.array(offsets)
