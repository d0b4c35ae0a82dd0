"""Words and hashes of Arrow text columns, computed on the raw bytes with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in one NumPy pass.
CHUNK = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def table(seed: int, fold_case: bool = False) -> np.ndarray:
    """A 64-bit value for each byte; with ``fold_case`` A-Z share those of a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * _ODD + np.uint64(seed))
    if fold_case:
        t[65:91] = t[97:123]
    return t


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** k`` for k below ``n``, modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        k = np.full(max(n, 1 << 16), base, np.uint64)
        k[0] = 1
        have = _POWERS[base] = np.cumprod(k)
    return have[:n]


def prefix(data: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Prefix sums with which :func:`spans` hashes any range of ``data``."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def spans(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges ``lo:hi``."""
    return (pre[hi] - pre[lo]) * powers(_INV, len(pre))[lo]


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``first, last, bytes, offsets`` of runs of whole texts of about ``most`` bytes; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    off = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and off[-1] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: ASCII letters and digits and every byte of a longer UTF-8 character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's range of words."""
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    on = inside[data]
    before = np.concatenate([[False], on[:-1]]) if len(on) else on
    lo = np.flatnonzero(on & (~before | edge[:-1]))
    after = np.concatenate([on[1:], [False]]) if len(on) else on
    hi = np.flatnonzero(on & (~after | edge[1:])) + 1
    return lo, hi, np.searchsorted(lo, off)


def grams(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of ``k`` words."""
    m = max(0, len(w) - k + 1)
    acc = np.full(m, np.uint64(k))
    for j in range(k):
        acc = acc * np.uint64(0xA24BAED4963EE407) + w[j : j + m]
    return mix(acc)


_PLAIN, _FOLDED = table(5), table(5, fold_case=True)


def _pieces(data: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about ``most`` bytes that end after white space; only a longer word makes one longer."""
    a = 0
    while a < len(data):
        b = min(len(data), a + most)
        while b < len(data):
            gap = np.flatnonzero(SPACE[data[b : b + 4096]])
            if len(gap):
                b += int(gap[0]) + 1
                break
            b = min(len(data), b + 4096)
        yield data[a:b]
        a = b


def word_runs(column: pa.Array, fold_case: bool = False, most: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``word hashes, range of each text`` of runs of whole texts; words are runs of bytes other than white space.

    One text may be longer than ``most``; it is hashed in pieces, so that it takes eight bytes a word
    and not several times its own size.
    """
    values = _FOLDED if fold_case else _PLAIN
    for _, _, data, off in chunks(column, most):
        if len(data) <= 2 * most:
            lo, hi, at = words(data, off, ~SPACE)
            yield spans(prefix(data, values), lo, hi), at
            continue
        parts = []
        for piece in _pieces(data, most):
            lo, hi, _ = words(piece, np.array([0, len(piece)]), ~SPACE)
            parts.append(spans(prefix(piece, values), lo, hi))
        w = np.concatenate(parts)
        yield w, np.array([0, len(w)])
