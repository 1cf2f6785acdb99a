"""Words of a text as numpy arrays: byte spans, 64-bit hashes, hashes of word runs.

Words are runs of bytes other than space and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``.  All
arithmetic wraps modulo 2**64, so a hash depends on the bytes of its words alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, np.bool_)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_BLOCK = 1 << 20
_TOGETHER = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def words_of(data: bytes) -> list[bytes]:
    return data.split()  # bytes are split at the space and 0x09-0x0D alone


def numbered(datas: list[bytes], starts_too: np.ndarray | None = None
             ) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of all texts as numbers from 0, the different words by number, words per text.

    With ``starts_too`` a word is also cut before each byte for which it holds after an ASCII letter.
    """
    kept, lengths, counts = [np.empty(0, np.uint8)], [np.zeros(1, np.int64)], [np.empty(0, np.int64)]
    first = 0
    while first < len(datas):  # so many texts at a time that the arrays stay in the cache
        last, size = first, 0
        while last < len(datas) and (last == first or size + len(datas[last]) <= _TOGETHER):
            size += len(datas[last]) + 1
            last += 1
        bytes_ = np.frombuffer(b"\n".join(datas[first:last]), np.uint8)
        inside = ~_SPACE[bytes_]
        start = inside.copy()
        start[1:] &= ~inside[:-1] if starts_too is None else ~inside[:-1] | (
            starts_too[bytes_[1:]] & _LETTER[bytes_[:-1]])
        starts = np.flatnonzero(start)
        part = bytes_[inside]
        lengths.append(np.diff((np.cumsum(inside, dtype=np.int32) - 1)[starts], append=len(part)))
        kept.append(part)
        edges = np.cumsum([0, *(len(d) + 1 for d in datas[first:last])])
        counts.append(np.diff(np.searchsorted(starts, edges)))
        first = last
    offsets = np.cumsum(np.concatenate(lengths), dtype=np.int64)
    plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [
        None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(kept))]).dictionary_encode()
    return (plain.indices.to_numpy(zero_copy_only=False).astype(np.int64), plain.dictionary.to_pylist(),
            np.concatenate(counts))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        for i, base in enumerate((BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def _block_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:len(data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word, by prefix sums of a polynomial; in blocks, so memory is bounded."""
    bytes_ = np.frombuffer(data, np.uint8)
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + _BLOCK, "right")))
        out[i:j] = _block_hashes(bytes_[low:ends[j - 1]], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` consecutive words; none if there are fewer words."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[:len(h) - k + 1].copy()
        for i in range(1, k):
            out = out * BASE + h[i:len(h) - k + 1 + i]
    return mix(out)
