"""Vectorised views of texts: words, lines and their 64-bit hashes, over batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SEED_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, b, np.uint64))]) for b in (_ODD, pow(_ODD, -1, 1 << 64))]
    return _POWERS[0][:n], _POWERS[1][:n]


def chunks(texts: Sequence[str | None], max_chars: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) with at most max_chars code points together, or one longer text alone; null is empty."""
    start, room, held = 0, 0, []
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if held and room + len(t) > max_chars:
            yield start, held
            start, room, held = i, 0, []
        held.append(t)
        room += len(t) + 1
    if held:
        yield start, held


class Texts:
    """Code points of some texts joined by newlines, with words ([^ \\t-\\r]+) and hashes of any spans."""

    def __init__(self, texts: Sequence[str], letters: bool = False):
        self.n = len(texts)
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.start = np.concatenate([[0], np.cumsum(lens + 1)])[:-1]
        self.length = lens
        c = self.codes
        gap = ~letter_table()[np.minimum(c, 65535)] if letters else (c == 32) | ((c >= 9) & (c <= 13))
        edge = np.diff(np.concatenate([[1], gap.view(np.int8)]))
        self.word_start = np.flatnonzero(edge == -1)
        self.word_end = np.flatnonzero(edge == 1)
        self.word_doc = self.doc_of(self.word_start)
        self.n_words = np.bincount(self.word_doc, minlength=self.n)
        self._sums: np.ndarray | None = None

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.start, at, side="right") - 1

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """Number of marked code points in each text."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.start + self.length] - total[self.start]

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self._sums is None:
            power, _ = _powers(len(self.codes))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.codes.astype(np.uint64) + _SEED_BASE) * power, dtype=np.uint64)])
        _, inverse = _powers(len(self.codes))
        at = np.minimum(start, len(self.codes) - 1)
        return mix((self._sums[end] - self._sums[start]) * inverse[at] + (end - start).astype(np.uint64) * _SEED_BASE)

    def word_hash(self) -> np.ndarray:
        return self.span_hash(self.word_start, self.word_end)


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """True for letters and digits of the basic plane; index 65535 stands for everything beyond it."""
    if not _LETTERS:
        t = np.fromiter((chr(i).isalnum() for i in range(65536)), bool, 65536)
        t[65535] = True
        _LETTERS.append(t)
    return _LETTERS[0]


def shingles(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every k-word window; a text of 1 to k - 1 words has one window, all its words."""
    h, doc = t.word_hash(), t.word_doc
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(t.n_words)])[:-1]
    size = np.minimum(t.n_words, k)[doc]
    left = t.n_words[doc] - (np.arange(n) - first[doc])
    power, inverse = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
    at = np.flatnonzero(left >= size)
    return doc[at], mix((sums[at + size[at]] - sums[at]) * inverse[at] + size[at].astype(np.uint64))


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) with their counts, documents ascending."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]))
    return doc[new], h[new], np.diff(np.concatenate([new, [len(h)]]))


def repeated(key: np.ndarray) -> np.ndarray:
    """True where the key stands at an earlier place too."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        k = key[order]
        new = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        out[:] = True
        out[np.minimum.reduceat(order, new)] = False
    return out


def symbol_table(symbols: str) -> np.ndarray:
    """True for the given ASCII characters; index 255 stands for everything beyond them."""
    t = np.zeros(256, bool)
    t[[ord(x) for x in symbols]] = True
    return t
