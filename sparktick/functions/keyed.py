"""Keyed randomness: a pure function of its keys, so it does not depend on partitioning or retries."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int) -> Column:
    """Uniform number in [0, 1) from the first 60 bits of md5 over the '|'-joined keys."""
    parts = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]
    hexed = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15)
    return F.conv(hexed, 16, 10).cast("long").cast("double") / F.lit(float(2**60))


def joined(*keys: Column | str | int) -> Column:
    """The text that `uniform` hashes: for draws made inside a task."""
    return F.concat_ws("|", *[(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys])


def uniforms(texts: Iterable[bytes], tails: Sequence[bytes] = (b"",)) -> np.ndarray:
    """`uniform` of keys that are joined already, inside a task: of each text with each tail, the tails of one text side by side."""
    return (first_words(list(texts), tails) >> np.uint64(4)).astype(np.float64).ravel() / 2.0**60


_FEW = 1024  # texts below which numpy's fixed cost of a call is more than that of hashing one by one
_TOGETHER = 1 << 14  # texts hashed together: their words stay in a core's cache
_TURNS = np.repeat(np.array([[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]), 4, axis=0).ravel().tolist()
_LEFT, _RIGHT = [np.uint32(t) for t in _TURNS], [np.uint32(32 - t) for t in _TURNS]
_ADDED = [np.uint32(int(2**32 * abs(math.sin(i + 1)))) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _mixed(state: list[np.ndarray], words: Sequence[np.ndarray]) -> list[np.ndarray]:
    """md5's step over one block of 16 words of many texts; a word that many texts share may have length one there."""
    a, b, c, d = state
    for i in range(64):
        if i < 16:
            f, at = c ^ d, i
            f &= b
            f ^= d
        elif i < 32:
            f, at = b ^ c, (5 * i + 1) % 16
            f &= d
            f ^= c
        elif i < 48:
            f, at = b ^ c, (3 * i + 5) % 16
            f ^= d
        else:
            f, at = ~d, 7 * i % 16
            f |= b
            f ^= c
        f += a
        f += words[at] + _ADDED[i]
        turned = f << _LEFT[i]
        f >>= _RIGHT[i]
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    return [x + y for x, y in zip(state, (a, b, c, d))]


def _first_words(words: Sequence[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """First eight bytes of md5 of padded texts, given their words."""
    state = [np.full(shape, x) for x in _START]
    for i in range(0, len(words), 16):
        state = _mixed(state, words[i : i + 16])
    return state[0].byteswap().astype(np.uint64) << np.uint64(32) | state[1].byteswap()


def _padded_size(length: int) -> int:
    return (length + 9 + 63) // 64 * 64


def _finish(padded: np.ndarray, length: int) -> None:
    """md5's end of a text of `length` bytes: a one bit, and the number of bits."""
    padded[:, length] = 128
    padded[:, -8:] = np.frombuffer(np.uint64(8 * length).tobytes(), np.uint8)


def first_words(texts: Sequence[bytes], tails: Sequence[bytes] = (b"",)) -> np.ndarray:
    """First eight bytes of md5 of every text (row) with every tail (column), as big-endian numbers.

    Many texts are hashed together by numpy: those of one length, with all tails of one length.
    """
    if len(texts) * len(tails) < _FEW:
        digests = b"".join([hashlib.md5(t + tail).digest() for t in texts for tail in tails])
        return np.frombuffer(digests, ">u8")[::2].astype(np.uint64).reshape(len(texts), len(tails))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends, data = np.cumsum(sizes), np.frombuffer(b"".join(texts), np.uint8)
    out = np.empty((len(texts), len(tails)), np.uint64)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        for more in sorted({len(t) for t in tails}):
            columns = [j for j, t in enumerate(tails) if len(t) == more]
            ending = np.zeros((len(columns), _padded_size(size + more)), np.uint8)
            ending[:, size : size + more] = np.frombuffer(b"".join(tails[j] for j in columns), np.uint8).reshape(len(columns), more)
            _finish(ending, size + more)
            last = ending.view("<u4")[:, None, :]
            for some in np.array_split(rows, -(-len(rows) * len(columns) // _TOGETHER)):
                padded = np.zeros((len(some), ending.shape[1]), np.uint8)
                padded[:, :size] = data[(ends[some] - size)[:, None] + np.arange(size)]
                first = np.ascontiguousarray(padded.view("<u4").T)[:, None, :]
                words = [w if 4 * i + 4 <= size else last[..., i] if 4 * i >= size else w | last[..., i] for i, w in enumerate(first)]
                out[np.ix_(some, columns)] = _first_words(words, (len(columns), len(some))).T
    return out


def gaussian(*keys: Column | str | int) -> Column:
    """Standard normal draw (Box-Muller over two keyed uniforms)."""
    u, v = uniform(*keys, "a"), uniform(*keys, "b")
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2.0 * math.pi * v)


SHUFFLE_ROUNDS = 20


def shuffle_shifts(size: Column, *keys: Column | str | int, rounds: int = SHUFFLE_ROUNDS) -> Column:
    """The shifts of `shuffled`'s rounds: the same for all positions, so worth computing before rows are made."""
    return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), lambda r: F.floor(uniform(*keys, "shift", r) * size))


def shuffled(position: Column, size: Column, shifts: Column, *keys: Column | str | int) -> Column:
    """Where a keyed permutation of 0 .. size-1 sends `position`, without enumerating the others (swap-or-not shuffle).

    A round pairs x with (shift - x) mod size, and one keyed bit of the pair decides whether its two members change places. Each
    round, and so the whole, is a permutation of any range: the images of the first n positions are n distinct numbers.
    """
    parts = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in keys]

    def one(x: Column, r: Column) -> Column:
        y = F.pmod(F.get(shifts, r) - x, size)
        bit = F.substring(F.md5(F.concat_ws("|", *parts, r.cast("string"), F.greatest(x, y).cast("string"))), 1, 1) < "8"
        return F.when(bit, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.size(shifts) - 1), position.cast("long"), one)


def images(positions: np.ndarray, size: int, shifts: Sequence[int], key: str) -> np.ndarray:
    """`shuffled` inside a task, for many positions of one permutation; `key` comes from `joined`."""
    x = positions.astype(np.int64)
    for r, shift in enumerate(shifts):
        y = (shift - x) % size
        x = np.where(_top_bits(f"{key}|{r}|".encode(), np.maximum(x, y)), x, y)
    return x


def _top_bits(head: bytes, numbers: np.ndarray) -> np.ndarray:
    """Whether md5 of the head and each number (its digits) has its first bit set."""
    if len(numbers) < _FEW:
        return np.array([hashlib.md5(head + b"%d" % v).digest()[0] >= 128 for v in numbers.tolist()], bool)
    out = np.empty(len(numbers), bool)
    digits = np.searchsorted(10 ** np.arange(1, 19), numbers, side="right") + 1
    sizes = np.array([_padded_size(len(head) + n) for n in range(20)])[digits]
    for size in np.unique(sizes).tolist():  # texts of as many blocks go together
        rows = np.flatnonzero(sizes == size)
        padded = np.zeros((len(rows), size), np.uint8)
        padded[:, : len(head)] = np.frombuffer(head, np.uint8)
        for n in np.unique(digits[rows]).tolist():
            some = np.flatnonzero(digits[rows] == n)
            part = padded[some]
            for j in range(n):
                part[:, len(head) + j] = numbers[rows[some]] // 10 ** (n - 1 - j) % 10 + 48
            _finish(part, len(head) + n)
            padded[some] = part
        words = padded.view("<u4")
        words = [w[:1] if same else w for w, same in zip(np.ascontiguousarray(words.T), (words == words[0]).all(axis=0))]
        out[rows] = _first_words(words, rows.shape) >> np.uint64(63) > 0
    return out
