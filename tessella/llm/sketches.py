"""Set sketches over numpy blocks: minwise hashing and fast similarity sketching, with banding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
CACHED = 1024
LONG = 65_535  # sizes from which they are not told apart
MAP = 56  # bits of a parity map: fewer let more pairs through by chance, more take more room
LOW = 40  # bits of a band hash that tell buckets of a part apart
EMPTY = U(0xFFFFFFFFFFFFFFFF)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)  # fixed values: multipliers of the splitmix64 finaliser


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(salt))


def minwise(values: np.ndarray, starts: np.ndarray, t: int, salt: int = 1) -> np.ndarray:
    """``t`` minima per set. ``values``: elements of all sets one after another, ``starts``: where each set begins; no
    set may be empty."""
    n = len(starts)
    out = np.empty((n, t), dtype=U)
    ends = np.append(starts, len(values))
    for a in range(0, n, CACHED):
        b = min(n, a + CACHED)
        mine, first = values[ends[a] : ends[b]], ends[a:b] - ends[a]
        for i, s in enumerate(seeds(t, salt)):
            out[a:b, i] = np.minimum.reduceat(mix(mine ^ s), first)
    return out


def fast_similarity(values: np.ndarray, starts: np.ndarray, t: int, salt: int = 2) -> np.ndarray:
    """Fast similarity sketch (Dahlgaard, Knudsen, Thorup 2017) with ``t`` bins per set.

    In rounds 0..t-1 every element is thrown into one of the t bins by that round's hash; in rounds t..2t-1 all
    elements go to the bin numbered by the round, so every bin fills. An earlier round beats a later one, within a
    round the smaller hash wins. A set leaves once its bins are full: about (t log t)/size rounds. Two sets agree in a
    bin with probability equal to their Jaccard similarity, with Chernoff-like concentration over the bins."""
    n = len(starts)
    out = np.full((n, t), EMPTY, dtype=U)
    ends = np.append(starts, len(values))
    marks = seeds(2 * t, salt)
    for a in range(0, n, CACHED):  # few enough sets for their bins to stay in the cache
        b = min(n, a + CACHED)
        _throw(values[ends[a] : ends[b]], np.diff(ends[a : b + 1]), marks[:t], out[a:b])
    late = np.flatnonzero((out == EMPTY).any(axis=1))  # small sets: rounds t..2t-1, bin by bin
    if len(late):
        sizes = np.diff(ends)[late]
        first = np.cumsum(sizes) - sizes
        elems = values[np.repeat(ends[late] - first, sizes) + np.arange(sizes.sum())]
        bins = out[late]
        for j in range(t):
            need = bins[:, j] == EMPTY
            if need.any():
                low = np.minimum.reduceat(mix(elems ^ marks[t + j]) & U(0xFFFFFFFF), first)
                bins[need, j] = (U(t + j) << U(32)) | low[need]
        out[late] = bins
    return out


def _throw(values: np.ndarray, sizes: np.ndarray, marks: np.ndarray, out: np.ndarray) -> None:
    """Rounds 0..t-1 of ``fast_similarity``."""
    n, t = out.shape
    flat = np.full(n * t, EMPTY, dtype=U)
    base, elems = np.repeat(np.arange(n) * t, sizes), values
    for i, s in enumerate(marks):
        h = mix(elems ^ s)
        at = base + (((h >> U(32)) * U(t)) >> U(32)).astype(np.int64)
        free = np.flatnonzero(flat[at] == EMPTY)  # an earlier round's value stands
        np.minimum.at(flat, at[free], (U(i) << U(32)) | (h[free] & U(0xFFFFFFFF)))
        if i % 16 == 15:
            open_ = (flat.reshape(n, t) == EMPTY).any(axis=1)
            if not open_.any():
                break
            keep = open_[base // t]
            base, elems = base[keep], elems[keep]
    out[:] = flat.reshape(n, t)


def bands(sketch: np.ndarray, rows: int, salt: int) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` coordinates; equal only if all coordinates are (but for collisions)."""
    n, t = sketch.shape
    grouped = sketch.reshape(n, t // rows, rows)
    acc = np.broadcast_to(seeds(t // rows, salt), (n, t // rows)).copy()
    for i in range(rows):
        acc = mix(acc ^ grouped[:, :, i]) + U(i)
    return acc


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width].T.tobytes()


def _from_planes(raw: np.ndarray, n: int, width: int, dtype: str) -> np.ndarray:
    out = np.zeros((n, np.dtype(dtype).itemsize), dtype=np.uint8)
    out[:, :width] = raw[: n * width].reshape(width, n).T
    return out.view(dtype).ravel()


#: Bytes of a packed entry: 40-bit hash (as the step from the one before), tag, flag, parity map, size.
_WIDTHS = (5, 8, 1, MAP // 8, 2)


def pack(hashes: np.ndarray, tags: np.ndarray, flags: np.ndarray, maps: np.ndarray, sizes: np.ndarray) -> bytes:
    """Entries of one part in order of their 40-bit hashes, as compressed byte planes."""
    steps = np.diff(hashes.astype("<u8"), prepend=np.uint64(0))
    columns = (steps, tags.astype("<i8"), flags.astype("u1"), maps.astype("<u8"), sizes.astype("<u2"))
    raw = b"".join(_planes(c, w) for c, w in zip(columns, _WIDTHS, strict=True))
    return len(hashes).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=n * sum(_WIDTHS), codec="zstd"), np.uint8)
    out, at = [], 0
    for w, dtype in zip(_WIDTHS, ("<u8", "<i8", "u1", "<u8", "<u2"), strict=True):
        out.append(_from_planes(raw[at:], n, w, dtype))
        at += n * w
    hashes, tags, flags, maps, sizes = out
    return np.cumsum(hashes, dtype=np.uint64), tags, flags, maps, sizes.astype(np.int64)


def parity(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Map of ``MAP`` bits per set: each element turns over one bit, so two maps differ in at most as many bits as the sets do
    in elements. No set may be empty."""
    return np.bitwise_xor.reduceat(U(1) << (mix(values) % U(MAP)), starts) if len(starts) else np.array([], dtype=U)
