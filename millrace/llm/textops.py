"""Vectorised text primitives over Arrow buffers: words, shingle hashes and the packing of integer runs.

A word is a maximal run of bytes outside \\x20 and \\x09-\\x0D. All hashes are 64 bits wide and depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

CHUNK = 1 << 20
_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, CHUNK + 64), np.uint64(base), np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def runs(column: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for consecutive whole rows of about `chunk` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + chunk, "right")) - 1)
        end = min(end, n, row + 32768)
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum of BYTE_HASH[data[t]] * P**t for t in i..j-1."""
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_HASH[data] * powers(_P, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span [start, end), the same wherever the same bytes stand."""
    with np.errstate(over="ignore"):
        raw = (prefix[end] - prefix[start]) * powers(_P_INV, len(prefix))[start]
        return mix(raw ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def words(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end and row of every word; rows are data[at[i]:at[i+1]]; gap tells the bytes between words."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    space = gap[data]
    first = np.empty(len(data), bool)
    first[0] = True
    np.copyto(first[1:], space[:-1])
    first[at[:-1][at[:-1] < len(data)]] = True
    start = np.flatnonzero(first & ~space)
    last = np.empty(len(data), bool)
    last[-1] = True
    np.copyto(last[:-1], space[1:])
    inner = at[1:-1]
    last[inner[inner > 0] - 1] = True
    end = np.flatnonzero(last & ~space) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def word_hashes(data: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row, start and end of each word, with A-Z lowered."""
    start, end, row = words(data, at, gap)
    return span_hash(prefix_hash(LOWER[data]), start, end), row, start, end


_COEF = (_RNG.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int = 5, whole: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, first word) of every k-word shingle; with `whole`, a row of 1 to k-1 words gives its whole sequence as one."""
    n = len(h)
    count = np.bincount(row, minlength=n_rows)
    base = np.cumsum(count) - count
    with np.errstate(over="ignore"):
        full = np.zeros(0, np.int64)
        out = np.zeros(0, np.uint64)
        if n >= k:
            full = np.flatnonzero(row[: n - k + 1] == row[k - 1 :])
            acc = np.zeros(n - k + 1, np.uint64)
            for j in range(k):
                acc += h[j : n - k + 1 + j] * _COEF[j]
            out = mix(acc[full])
        if whole:
            short = np.flatnonzero((count > 0) & (count < k))
            extra = np.zeros(len(short), np.uint64)
            for j in range(k - 1):
                on = count[short] > j
                extra[on] += h[base[short[on]] + j] * _COEF[j]
            extra = mix(extra + count[short].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
            return np.concatenate([out, extra]), np.concatenate([row[full], short]), np.concatenate([full, base[short]])
    return out, row[full], full


_zip, _unzip = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray) -> bytes:
    """Integers (unsigned, or known to be non-negative) as byte planes, compressed; planes that are all zero cost next to nothing."""
    u = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(u.view(np.uint8).reshape(-1, u.itemsize).T)
    return _zip.compress(u.dtype.str[1:].encode() + planes.tobytes())


def unsqueeze(b: bytes) -> np.ndarray:
    raw = _unzip.decompress(b)
    dtype = np.dtype(raw[:2].decode())
    planes = np.frombuffer(raw, np.uint8, offset=2).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def squeeze_sorted(x: np.ndarray) -> bytes:
    """A sorted uint64 run as compressed differences."""
    d = np.empty(len(x), np.uint64)
    if len(x):
        d[0] = x[0]
        np.subtract(x[1:], x[:-1], out=d[1:])
    return squeeze(d)


def unsqueeze_sorted(b: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(unsqueeze(b), dtype=np.uint64)
