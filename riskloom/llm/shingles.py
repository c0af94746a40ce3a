"""Sets of word shingles as sorted 64-bit hashes, for many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_UNDO = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every bit depends on every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, _UNDO)]
    return _powers


def shingle_sets(texts: list[str | None], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text's shingles, sorted, one text after the other; and where each text's begin (n + 1 places).

    Words are runs of bytes other than space and tab to carriage return, with A-Z in lower case. A text with
    fewer words than a shingle has its whole word sequence as its only shingle; without words or text it has none.
    """
    plain = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) if t else b"" for t in texts]
    n_words = np.array([p.count(b" ") + 1 if p else 0 for p in plain], np.int64)
    buf = np.frombuffer(b"".join([p + b" " for p in plain if p]), np.uint8)
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    power, undo = _power_tables(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[buf] * power[: len(buf)], out=sums[1:])
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate(([0], ends[:-1] + 1))
    first_word = np.concatenate(([0], np.cumsum(n_words)))
    doc = np.repeat(np.arange(len(texts)), n_words)
    last = first_word[doc + 1] - 1  # of each word's text
    word = np.arange(len(doc))
    begins = (word + size - 1 <= last) | ((word == first_word[doc]) & (n_words[doc] < size))
    word, doc = word[begins], doc[begins]
    a, b = starts[word], ends[np.minimum(word + size - 1, last[begins])]
    hashes = mix((sums[b] - sums[a]) * undo[a])
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def groups_of(texts: list[str | None], most_bytes: int = 1 << 20):
    """Ranges of texts that together have about ``most_bytes``, so that long ones don't add up."""
    begin, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if held and held + n > most_bytes:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(texts):
        yield begin, len(texts)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
