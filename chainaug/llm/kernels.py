"""Vectorised text kernels (numpy over the UTF-8 bytes of many texts at once).

A chunk of texts is one byte buffer with a separator between texts, so one pass of array
operations finds the words of all of them.  Word identity is a 64-bit polynomial hash of the
bytes, scrambled afterwards; callers that need certainty compare the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19  # bytes of text worked on at once: bounds the temporary arrays

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: byte classes of words: True where a byte belongs to a word
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[0x30:0x3A] = True
ALNUM_WORDS[0x61:0x7B] = True
ALNUM_WORDS[0x80:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, grown to the longest chunk seen."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            up = np.full(size, _BASE, dtype=np.uint64)
            down = np.full(size, _BASE_INV, dtype=np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words:
    """Words of a chunk of texts: byte ranges ``start``/``end`` in ``buf``, 64-bit ``hash``, and
    ``first`` (text i has the words first[i] .. first[i+1]-1); text i begins at ``offset[i]``."""

    def __init__(self, texts: list[bytes], classes: np.ndarray, between: bytes = b" "):
        """``between`` is one byte that no word holds; it parts the texts."""
        buf = np.frombuffer(between.join([*texts, b""]), dtype=np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.offset = np.concatenate(([0], np.cumsum(lengths)))
        inside = classes[buf]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        self.buf, self.start, self.end = buf, edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        up, down = _POWERS.upto(len(buf) + 1)
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)])))
        self.hash = mix64((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64) * _MUL)

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words that begin at each word (the last n-1 entries of a text run into the
        next text; ``inside(n)`` tells them apart)."""
        count = len(self.hash)
        out = np.full(count, np.uint64(n), dtype=np.uint64)
        for j in range(n):
            # the first product scrambles position j, so order matters
            most = max(count - j, 0)  # a chunk may hold fewer words than a window
            out[:most] = out[:most] * _MUL + self.hash[j:]
        return mix64(out)

    def inside(self, n: int) -> np.ndarray:
        """True at the words whose window of n ends in the same text."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.hash)) + n <= last


def chunks(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``most`` bytes each (a longer text is a chunk of its own)."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null is empty."""
    binary = column.cast(pa.large_binary()) if pa.types.is_large_string(column.type) else column.cast(pa.binary())
    return [t or b"" for t in binary.to_pylist()]
