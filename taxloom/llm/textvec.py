"""Vectorised word work on batches of UTF-8 texts, used inside tasks.

A chunk of texts is laid end to end in one byte buffer; words are found with
a 256-entry byte table and hashed with a rolling polynomial, so the cost per
byte is a handful of numpy passes. Memory is bounded by the chunk size, not
by the partition: long texts are hashed in segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C55 | 1
_SEGMENT = 1 << 20


def byte_table(separators: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


#: Words are runs of anything but space, tab, line feed, VT, FF and CR.
SPACED = byte_table(b" \t\n\x0b\x0c\r")
#: Words are runs of digits, ASCII letters (lower-cased first) and non-ASCII bytes.
ALNUM = byte_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; spreads every input bit over the output."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**j and p**-j modulo 2**64 for j < n at least."""
    if not _powers or len(_powers["up"]) < n:
        n = max(n, _SEGMENT + 1)
        for name, base in (("up", _P), ("down", pow(_P, -1, 1 << 64))):
            step = np.full(n, base, dtype=U)
            step[0] = 1
            _powers[name] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """Words of consecutive texts: word i is buf[start[i]:end[i]]; text d owns words first[d]:first[d + 1]."""

    buf: np.ndarray
    raw: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    #: Byte offset of every text in buf.
    text_at: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return self.parts([0])[0]

    def parts(self, sizes: list[int]) -> list[np.ndarray]:
        """For every size a hash of each word's first `size` bytes (its last ones if negative, all of it if 0).

        A word shorter than a size is hashed whole.
        """
        out = [np.empty(len(self.start), dtype=U) for _ in sizes]
        i, n = 0, len(self.start)
        while i < n:
            base = int(self.start[i])
            j = max(i + 1, int(np.searchsorted(self.end, base + _SEGMENT, "right")))
            end = int(self.end[j - 1])
            up, down = powers(end - base + 1)
            sums = np.zeros(end - base + 1, dtype=U)
            np.cumsum((self.buf[base:end].astype(U) + U(1)) * up[: end - base], out=sums[1:])
            start, stop = self.start[i:j] - base, self.end[i:j] - base
            for k, size in enumerate(sizes):
                s = np.maximum(start, stop + size) if size < 0 else start
                e = np.minimum(stop, start + size) if size > 0 else stop
                out[k][i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U) * U(0xD6E8FEB86659FD93))
            i = j
        return out


def words_of(texts: list[bytes], table: np.ndarray) -> Words:
    raw = b" ".join(texts)
    buf = np.frombuffer(raw, dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    text_at = np.concatenate([[0], np.cumsum(lengths)])
    mask = np.zeros(len(buf) + 2, dtype=np.int8)
    mask[1:-1] = table[buf]
    edges = np.flatnonzero(mask[1:] != mask[:-1])
    start, end = edges[::2], edges[1::2]
    first = np.searchsorted(start, text_at)
    return Words(buf, raw, start, end, first, text_at)


def chunks(texts: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes; null is empty) in runs of about `most` bytes."""
    out: list[bytes] = []
    at = size = 0
    for i, t in enumerate(texts.cast(pa.large_binary())):
        b = t.as_py() or b""
        if out and size + len(b) > most:
            yield at, out
            at, out, size = i, [], 0
        out.append(b)
        size += len(b)
    if out:
        yield at, out


def combine(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n consecutive words inside a text, and each run's first word."""
    if len(h) < n:
        return np.empty(0, dtype=U), np.empty(0, dtype=np.int64)
    acc = np.zeros(len(h) - n + 1, dtype=U)
    weight = 1
    for k in range(n):
        weight = weight * 0xC2B2AE3D27D4EB4F % (1 << 64)
        acc += h[k : len(h) - n + 1 + k] * U(weight)
    inside = np.ones(len(acc), dtype=bool)
    for k in range(1, n):  # runs that cross into the next text
        at = first[1:-1] - k
        inside[at[(at >= 0) & (at < len(acc))]] = False
    at = np.flatnonzero(inside)
    return mix(acc[at]), at


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words start[i]:end[i] for every i, in order."""
    up, down = powers(len(h) + 1)
    sums = np.zeros(len(h) + 1, dtype=U)
    np.cumsum(h * up[: len(h)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
