"""Texts as numpy arrays inside tasks: word hashes, shingles and random bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: ASCII white space: what separates words.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that are hashed at once.
PART = 1 << 20
BASE = 0x9E3779B97F4A7C15


def scrambled(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits per 64-bit number; a one-to-one map."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_bits(count: int, seed: int) -> np.ndarray:
    """The same 64-bit numbers in every run."""
    return scrambled(scrambled(np.arange(1, count + 1, dtype=np.uint64)) + np.uint64(seed * 0x632BE59B + 1))


class RangeHash:
    """Polynomial hashes of byte ranges of a buffer, all from one running sum."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.up):
            inverse = pow(BASE, -1, 1 << 64)
            size = max(n, PART + 1)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
                for b in (BASE, inverse)
            )

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of ``data[start:end]`` for each pair; depends on these bytes only."""
        self._powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=sums[1:])
        return scrambled((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a buffer."""
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    return change[0::2], change[1::2]


def parts(data: bytes, size: int = PART) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that cut no word."""
    at = 0
    while len(data) - at > size:
        cut = data.rfind(b" ", at, at + size)
        if cut <= at:
            cut = data.find(b" ", at + size)
        if cut < 0:
            break
        yield data[at:cut]
        at = cut
    yield data[at:]


def word_hashes(texts: list[bytes], hasher: RangeHash) -> Iterator[np.ndarray]:
    """For each text, the hashes of its words in order."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > PART:
            held = list(parts(texts[at]))
            if len(held) > 1:
                yield np.concatenate([next(word_hashes([p], hasher)) for p in held])
                at += 1
                continue
        group, size = [texts[at]], len(texts[at])
        while at + len(group) < len(texts) and size + len(texts[at + len(group)]) < PART:
            group.append(texts[at + len(group)])
            size += len(group[-1]) + 1
        data = np.frombuffer(b" ".join(group), dtype=np.uint8)
        start, end = word_edges(data)
        hashes = hasher(data, start, end)
        begins = np.cumsum([0] + [len(t) + 1 for t in group])
        cuts = np.searchsorted(start, begins)
        for k in range(len(group)):
            yield hashes[cuts[k] : cuts[k + 1]]
        at += len(group)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-word windows; a shorter text is one window, an empty one has none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    width = min(n, len(words))
    factors = random_bits(n, 7) | np.uint64(1)
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += words[k : len(words) - width + 1 + k] * factors[k]
    return np.unique(scrambled(total))
