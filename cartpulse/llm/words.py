"""Words and word n-grams of an Arrow batch of texts, as NumPy arrays.

The helpers below look at the UTF-8 bytes of many texts at once; no word
becomes a Python object.  A word is a maximal run of bytes of a byte class;
both classes used here treat every byte over 0x7F as a word byte, so a run
of bytes is the same as the run of code points of the regular expression
it stands for:

* ``SPACED``: ``[^\\x20\\x09-\\x0D]+``, unchanged
* ``ALNUM``: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z

A null text has no words.  Batches are walked in pieces of about 1 MB (or one
text, where that is longer), so memory follows the longest text of a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
U = np.uint64
_MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U((0x9E3779B97F4A7C15 * (2 * seed + 1)) & _MASK))


def _base(seed: int) -> int:
    return int(mix(np.array([seed * 2654435761 + 97], dtype=U))[0]) | 1


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._run(self.base, n), self._run(self.inverse, n)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _run(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, U)
        out[0] = 1
        return np.cumprod(out, dtype=U)


BYTE_POWERS = {seed: Powers(_base(seed)) for seed in (1, 2)}
WORD_POWERS = {seed: Powers(_base(seed)) for seed in (11, 12)}


@dataclass(frozen=True)
class ByteClass:
    word: np.ndarray
    case: np.ndarray

    def table(self, seed: int) -> np.ndarray:
        return _table(seed)[self.case]


def _classes() -> tuple[ByteClass, ByteClass]:
    same = np.arange(256)
    lower = np.where((same >= 0x41) & (same <= 0x5A), same + 32, same)
    spaced = ~((same == 0x20) | ((same >= 9) & (same <= 13)))
    alnum = (same >= 0x80) | ((lower >= 0x30) & (lower <= 0x39)) | ((lower >= 0x61) & (lower <= 0x7A))
    return ByteClass(spaced, same), ByteClass(alnum, lower)


SPACED, ALNUM = _classes()


@dataclass
class Piece:
    """Words of consecutive texts: word j is ``data[starts[j]:ends[j]]``; text
    i of the piece (row ``first + i`` of the batch) has words
    ``bounds[i]:bounds[i + 1]``."""

    first: int
    data: np.ndarray
    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    cls: ByteClass

    def word_hashes(self, seed: int = 1) -> np.ndarray:
        up, down = BYTE_POWERS[seed].upto(max(len(self.data), 1))
        sums = np.empty(len(self.data) + 1, U)
        sums[0] = 0
        np.cumsum(self.cls.table(seed)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))

    def span_hashes(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 11) -> np.ndarray:
        """Hash of words ``begin[i]:end[i]`` for each i; equal word sequences give equal hashes."""
        up, down = WORD_POWERS[seed].upto(max(len(hashes), 1) + 1)
        sums = np.empty(len(hashes) + 1, U)
        sums[0] = 0
        np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
        return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U))

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First word of every run of k words of one text, and the piece's text number of each."""
        text = self.text_of_word()
        at = np.arange(max(len(text) - k + 1, 0))
        at = at[text[at] == text[at + k - 1]]
        return at, text[at]

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def word_bytes(self, j: int) -> bytes:
        return self.data[self.starts[j] : self.ends[j]].tobytes()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(texts: pa.Array, cls: ByteClass, size: int = PIECE_BYTES) -> Iterator[Piece]:
    raw, off = flat(texts)
    first = 0
    while first < len(off) - 1:
        last = max(int(np.searchsorted(off, off[first] + size, "right")) - 1, first + 1)
        data, rows = raw[off[first] : off[last]], off[first : last + 1] - off[first]
        word = np.empty(len(data) + 2, bool)
        word[0] = word[-1] = False
        word[1:-1] = cls.word[data]
        # a text's first byte never continues the word of the text before
        edge = np.zeros(len(data) + 1, bool)
        edge[rows] = True
        begins = word[1:] & (~word[:-1] | edge)
        stops = word[:-1] & (~word[1:] | edge)
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
        yield Piece(first, data, rows, starts, ends, np.searchsorted(starts, rows), cls)
        first = last


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
