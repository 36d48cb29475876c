"""NumPy kernels over the UTF-8 bytes of an Arrow string column.

Words are runs of bytes other than space and 0x09-0x0D. All separators are ASCII, so
working on bytes gives the same words as working on characters. Hashes chain a bijective
mixer over eight bytes, or over two halves, at a time: they are no polynomials, so no pair of
words or word sequences of some regular build shares one. Where a decision rests on equality alone,
a cryptographic digest of 128 bits or the bytes themselves are compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
CHUNK_BYTES = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chunks(column: pa.Array):
    """Yields (first row, bytes, offsets) of runs of whole rows, CHUNK_BYTES or one row each; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = int(np.searchsorted(off, off[at] + CHUNK_BYTES, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def word_bounds(data: np.ndarray, off: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the index of each document's first word (one more at the end)."""
    solid = ~separator[data]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(data))]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_TAIL = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
#: Longer spans are hashed one by one.
LONG_SPAN = 4096


def eights(data: np.ndarray) -> np.ndarray:
    """At each place of data the eight bytes from there on as one little-endian number; zeros follow the end."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A uint64 hash of data[s:e] for every span; equal bytes give equal hashes wherever they lie."""
    length = ends - starts
    eight = eights(data)
    with np.errstate(over="ignore"):
        h = length.astype(np.uint64) * _STEP + np.uint64(seed * 0x2545F4914F6CDD1D & (2**64 - 1))
        live, at, left = slice(None), starts, length
        long = length > LONG_SPAN
        if long.any():
            live = np.flatnonzero(~long)
            at, left = starts[live], length[live]
            raw = data.tobytes()
            for i in np.flatnonzero(long):
                h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=8, salt=bytes([seed])).digest(), "little")
        while len(at):
            h[live] = mix(h[live] ^ (eight[at] & _TAIL[np.minimum(left, 8)]))
            more = np.flatnonzero(left > 8)
            live = more if isinstance(live, slice) else live[more]
            at, left = at[more] + 8, left[more] - 8
    return h


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what a and b stand for, one after the other."""
    with np.errstate(over="ignore"):
        return mix(a * _STEP + b)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of words[i:i+width] for each i that has so many words after it (uint64, length len(words)-width+1)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, size = None, 0, words, 1
    while True:
        if width & size:
            out = power[:n] if out is None else join_hashes(out, power[done : done + n])
            done += size
        if done == width:
            return out if width > 1 else mix(out)
        power = join_hashes(power[:-size], power[size:])
        size *= 2


def text_digests(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """uint64 [documents, 2]: the BLAKE2b digest of each document's words, joined by one space."""
    raw = data.tobytes()
    ends = off.tolist()
    out = b"".join(hashlib.blake2b(b" ".join(raw[s:e].split()), digest_size=16).digest() for s, e in zip(ends[:-1], ends[1:], strict=True))
    return np.frombuffer(out, "<u8").reshape(-1, 2)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
