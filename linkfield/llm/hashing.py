"""64-bit hashes of the words and shingles of many texts at once, in numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes that are hashed at once; a window ends where white space does.
WINDOW = 1 << 20

_rng = np.random.default_rng(20240531)
_odd = lambda n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_odd(1)[0]) | 2  # of the form 4k + 3
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = _odd(256)
_FACTORS = _odd(64)

ASCII_SPACE = np.zeros(256, bool)
ASCII_SPACE[[32, 9, 10, 11, 12, 13]] = True

_LOWER = np.arange(256)
_LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers.get(base, ())) < n:
        x = np.full(n, base, np.uint64)
        x[0] = 1
        _powers[base] = np.cumprod(x)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(data: np.ndarray, separators: np.ndarray = ASCII_SPACE) -> Iterator[tuple[int, int]]:
    """(from, to) of about WINDOW bytes each that end after a separator; a longer word makes a longer window."""
    a = 0
    while a < len(data):
        b = min(a + WINDOW, len(data))
        if b < len(data):
            cut = np.flatnonzero(separators[data[a:b]])
            if len(cut):
                b = a + int(cut[-1]) + 1
            else:
                while b < len(data) and not separators[data[b - 1]]:
                    start, b = b, min(b + WINDOW, len(data))
                    cut = np.flatnonzero(separators[data[start:b]])
                    b = start + int(cut[0]) + 1 if len(cut) else b
        yield a, b
        a = b


def spans(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of bytes that aren't gaps."""
    edge = np.diff(gap.astype(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class SpanHasher:
    """Hashes of any spans of some bytes, with A-Z as a-z, wherever the spans stand."""

    def __init__(self, part: np.ndarray):
        self.total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[_LOWER[part]] * _power(_BASE, len(part)), out=self.total[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        back = _power(_INVERSE, len(self.total))[start] if len(start) else np.zeros(0, np.uint64)
        return mix((self.total[end] - self.total[start]) * back)


def word_hashes(texts: Sequence[str], separators: np.ndarray = ASCII_SPACE, prefixes: Sequence[int] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first word of each text and their total, hash of each word, hashes of each word's first n bytes by n).

    Words are runs of bytes that separators doesn't mark; A-Z count as a-z.  separators must mark the line feed.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in raw)])[:-1]
    at, hashes, short = [], [], [[] for _ in prefixes]
    for a, b in windows(data, separators):
        part = data[a:b]
        start, end = spans(separators[part])
        hashed = SpanHasher(part)
        hashes.append(hashed(start, end))
        for n, out in zip(prefixes, short, strict=True):
            out.append(hashed(start, np.minimum(end, start + n)))
        at.append(start + a)
    at = np.concatenate(at)
    firsts = np.append(np.searchsorted(at, begins), len(at))
    return firsts, np.concatenate(hashes), [np.concatenate(x) for x in short]


def combined(words: np.ndarray, steps: Sequence[int], kind: int) -> np.ndarray:
    """A hash for the words at i + steps, for each i where all exist; kind keeps sorts of features apart."""
    n = len(words) - max(steps)
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, kind, np.uint64)
    for k, s in enumerate(steps):
        total += words[s : s + n] * _FACTORS[(kind * 8 + k) % 64]
    return mix(total)


def shingle_sets(texts: Sequence[str], size: int = 5) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted hashes; fewer words than size are one shingle, none are none."""
    firsts, words, _ = word_hashes(texts)
    every = combined(words, range(size), 1)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        if b - a >= size:
            x = np.sort(every[a : b - size + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif b > a:
            out.append(combined(words[a:b], range(b - a), 2 + int(b - a))[:1])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
