"""Whole-batch text primitives in numpy: code points, character classes, folding, rolling hashes."""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multiplier of the rolling polynomial (odd, so it has an inverse modulo 2**64).
BASE = 0x9E3779B97F4A7C15
SEPARATOR = "\ue000"  # private use; folding drops it from texts before it is put between them


@functools.cache
def category_table() -> np.ndarray:
    """First letter of the Unicode general category of every code point, as a byte."""
    return np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(sys.maxunicode + 1)).encode(), dtype=np.uint8)


@functools.cache
def word_table() -> np.ndarray:
    """Whether a code point is a letter, a mark or a number."""
    t = category_table()
    return (t == ord("L")) | (t == ord("M")) | (t == ord("N"))


def strings(col: pa.Array) -> pa.Array:
    """Nulls become empty strings."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return pc.fill_null(col.cast(pa.string()), "")


def codes(text: str) -> np.ndarray:
    """Code points of a string."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def batch_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a batch in one array, and the offsets of its rows."""
    col = strings(col)
    lengths = pc.utf8_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    joined = "".join(col.to_pylist())
    return codes(joined), np.concatenate([[0], np.cumsum(lengths)])


def fold_text(text: str | None) -> str:
    """NFKC form, case folded, only letters, digits and combining marks; null gives ''."""
    return fold_batch(pa.array([text], type=pa.string()))[0] if text else ""


def fold_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a whole batch, and the offsets of its rows."""
    sep = ord(SEPARATOR)
    texts = [t.replace(SEPARATOR, " ") if SEPARATOR in t else t for t in strings(col).to_pylist()]
    joined = unicodedata.normalize("NFKC", SEPARATOR.join(texts)).casefold()
    a = codes(joined)
    keep = word_table()[a]
    ends = np.flatnonzero(a == sep)
    kept = np.concatenate([[0], np.cumsum(keep)])
    offsets = np.concatenate([[0], kept[ends], [kept[-1]]]).astype(np.int64)
    return a[keep], offsets if texts else np.zeros(1, dtype=np.int64)


def fold_batch(col: pa.Array) -> list[str]:
    """Folded texts of a batch."""
    a, at = fold_codes(col)
    s = a.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [s[i:j] for i, j in zip(at[:-1], at[1:])]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all (multiply and shift rounds)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(16, int(n - 1).bit_length())
    if size not in _POWERS:
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        up, down = np.full(size, np.uint64(BASE)), np.full(size, inverse)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def prefix_hash(a: np.ndarray) -> np.ndarray:
    """Sums of code point terms, from which `window_hash` takes any window's hash."""
    up, _ = powers(len(a) + 1)
    x = a.astype(np.uint64)
    x += np.uint64(1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= up[: len(a)]
    out = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def window_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hashes of the windows [start, end) of the array behind ``prefix``."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x94D049BB133111EB))


def rolling_hash(prefix: np.ndarray, k: int) -> np.ndarray:
    """Mixed hashes of all windows of k, over rows alike; those across rows are for the caller to drop."""
    n = len(prefix) - 1
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(n + 1)
    h = prefix[k:] - prefix[:-k]
    h *= down[: n - k + 1]
    h += np.uint64(k * 0x94D049BB133111EB & (2**64 - 1))
    return mix(h)


def window_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum over every w successive values, by minima from both ends of blocks of w."""
    n = len(h)
    if n < w:
        return h[:0]
    pad = -n % w
    p = np.concatenate([h, np.full(pad, np.iinfo(h.dtype).max, dtype=h.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def winnow(h: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions that winnowing selects: of each w successive windows of a row the least hash.

    ``ok`` marks windows within a row; any run of w of them holds a selected one, so two equal
    stretches of ``k + w - 1`` characters have a selected window in common. A row with fewer
    than w windows is for the caller.
    """
    big = np.where(ok, h, np.iinfo(np.uint64).max)
    low = window_minimum(big, w)
    pick = np.zeros(len(h), dtype=bool)
    if len(low) == 0:
        return np.flatnonzero(pick)
    # A position is selected if it is the minimum of some window of w that has it: the largest of
    # the minima of the windows that hold position i equals its own hash.
    padded = np.concatenate([np.zeros(w - 1, dtype=np.uint64), low, np.zeros(w - 1, dtype=np.uint64)])
    most = ~window_minimum(~padded, w)
    pick = (most == big) & ok
    return np.flatnonzero(pick)
