"""Elias-Fano sequences over memory-mapped words, searched for many values at once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np

from .common import file_system

_ONE = np.uint64(1)
_BYTES = np.uint64(0x0101010101010101)
#: Bytes of fetched files that a worker's folder keeps; the ones not used for longest go.
FETCHED_BYTES = 8 << 30
#: Place of the k-th set bit of a byte.
_IN_BYTE = np.array([([k for k in range(8) if x >> k & 1] + [0] * 8)[:8] for x in range(256)], np.int64).ravel()


def _gathered(size: int, word: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Words made of values that fall into them; word is ascending, bits don't overlap."""
    out = np.zeros(size, np.uint64)
    if len(word):
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[start]] = np.add.reduceat(value, start)
    return out


class EliasFano:
    """A non-decreasing sequence of n numbers below a bound, in about 2 + log2(bound / n) bits each."""

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.ones = n, low_bits, high, low, ones
        self._zeros = None

    @staticmethod
    def of(values: np.ndarray, bound: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        k = max(0, (max(bound, 1) // max(n, 1)).bit_length() - 1)
        tops = (values >> np.uint64(k)).astype(np.int64)
        at = tops + np.arange(n)
        words = (max(bound - 1, 0) >> k) + 1 + n
        words = words // 64 + 2
        high = _gathered(words, at >> 6, _ONE << (at & 63).astype(np.uint64))
        if k:
            bits, first = values & np.uint64((1 << k) - 1), np.arange(n) * k
            shift = (first & 63).astype(np.uint64)
            low = _gathered(n * k // 64 + 2, first >> 6, bits << shift)
            over = np.flatnonzero(shift > 64 - k)
            low |= _gathered(len(low), (first[over] >> 6) + 1, bits[over] >> (np.uint64(64) - shift[over]))
        else:
            low = np.zeros(2, np.uint64)
        return EliasFano(n, k, high, low, np.r_[0, np.cumsum(np.bitwise_count(high), dtype=np.int64)].astype(np.uint32))

    def arrays(self) -> dict[str, np.ndarray]:
        return {"high": self.high, "low": self.low, "ones": self.ones}

    def _select(self, rank: np.ndarray, bit: int) -> np.ndarray:
        """Positions of the set (bit 1) or unset (bit 0) bits of these ranks, from 0."""
        if bit:
            before = self.ones
        else:
            if self._zeros is None:
                self._zeros = (np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones).astype(np.uint32)
            before = self._zeros
        rank = rank.astype(np.uint32)
        at = np.searchsorted(before, rank, "right") - 1
        left = (rank - before[at]).astype(np.uint64)
        word = self.high[at] if bit else ~self.high[at]
        # running bit counts of the bytes, side by side; then the byte, then the bit in it
        sums = word - (word >> _ONE & np.uint64(0x5555555555555555))
        sums = (sums & np.uint64(0x3333333333333333)) + (sums >> np.uint64(2) & np.uint64(0x3333333333333333))
        sums = (sums + (sums >> np.uint64(4)) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _BYTES
        tops = _BYTES << np.uint64(7)
        byte = np.bitwise_count(((left * _BYTES | tops) - sums) & tops).astype(np.uint64) << np.uint64(3)
        left = left - ((sums << np.uint64(8)) >> byte & np.uint64(255))
        inside = _IN_BYTE[((word >> byte & np.uint64(255)) << np.uint64(3) | left).astype(np.int64)]
        return at * 64 + byte.astype(np.int64) + inside

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        first = i * self.low_bits
        at, shift = first >> 6, (first & 63).astype(np.uint64)
        over = np.where(shift > 0, self.low[at + 1] << (np.uint64(64) - np.maximum(shift, _ONE)), np.uint64(0))
        return (self.low[at] >> shift | over) & np.uint64((1 << self.low_bits) - 1)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at these positions."""
        i = np.asarray(i, np.int64)
        return (self._select(i, 1) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._lows(i)

    def successor(self, value: np.ndarray) -> np.ndarray:
        """For each value, the first position whose number is not below it; n if there is none."""
        value = np.asarray(value, np.uint64)
        top = (value >> np.uint64(self.low_bits)).astype(np.int64)
        inside = top <= int(self._select(np.array([self.n - 1]), 1)[0]) - (self.n - 1) if self.n else np.zeros(len(value), bool)
        out = np.full(len(value), self.n, np.int64)
        if not inside.any():
            return out
        top, low = top[inside], value[inside] & np.uint64((1 << self.low_bits) - 1)
        start = np.where(top > 0, self._select(np.maximum(top - 1, 0), 0) - np.maximum(top - 1, 0), 0)
        stop = self._select(top, 0) - top
        a, b = start.copy(), stop.copy()
        active = np.flatnonzero(a < b)
        while len(active):  # binary search on the low bits within a bucket
            mid = (a[active] + b[active]) >> 1
            below = self._lows(mid) < low[active]
            a[active[below]] = mid[below] + 1
            b[active[~below]] = mid[~below]
            active = active[a[active] < b[active]]
        out[inside] = a
        return out

    def find(self, value: np.ndarray) -> np.ndarray:
        """Positions of these values; -1 where a value is absent."""
        at = self.successor(value)
        there = np.flatnonzero(at < self.n)
        out = np.full(len(at), -1, np.int64)
        same = self.access(at[there]) == np.asarray(value, np.uint64)[there]
        out[there[same]] = at[there[same]]
        return out


def save(path: str, name: str, parts: dict[str, EliasFano | np.ndarray], facts: dict | None = None) -> str:
    """Writes sequences and plain arrays into one file of a new name below a folder; its URI."""
    system, base = file_system(path)
    system.create_dir(base, recursive=True)
    arrays: dict[str, np.ndarray] = {}
    head: dict = {"facts": facts or {}, "sequences": {}, "arrays": {}}
    for key, part in parts.items():
        if isinstance(part, EliasFano):
            head["sequences"][key] = [part.n, part.low_bits]
            arrays |= {f"{key}.{k}": a for k, a in part.arrays().items()}
        else:
            arrays[key] = part
    at = 0
    for key, a in arrays.items():
        head["arrays"][key] = [at, a.dtype.str, len(a)]
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    file = f"{name}-{uuid.uuid4().hex}.ef"
    with system.open_output_stream(f"{base}/{file}") as out:
        out.write(len(text).to_bytes(8, "little"))
        out.write(text)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes())
            out.write(b"\0" * (-a.nbytes % 8))
    return f"{path.rstrip('/')}/{file}"


def _evict(folder: str, newest: str) -> None:
    """Deletes fetched files beyond FETCHED_BYTES; one that a task has mapped stays readable to it."""
    held = []
    with os.scandir(folder) as entries:
        for entry in entries:
            if entry.name.endswith(".ef"):
                try:
                    held.append((entry.name == newest, entry.stat().st_mtime, entry.stat().st_size, entry.path))
                except FileNotFoundError:  # another worker was quicker
                    continue
    over = sum(size for _, _, size, _ in held) - FETCHED_BYTES
    for is_newest, _, size, path in sorted(held):
        if over <= 0 or is_newest:
            break
        over -= size
        try:
            os.remove(path)
        except FileNotFoundError:
            continue


def _fetched(system, name: str) -> np.memmap:
    """A file of a store, mapped from the worker's folder; fetched if it is not there (any more)."""
    local = os.path.join(tempfile.gettempdir(), os.path.basename(name))
    while True:
        try:
            os.utime(local)
            return np.memmap(local, np.uint8, "r")
        except FileNotFoundError:
            with system.open_input_file(name) as source, tempfile.NamedTemporaryFile(dir=tempfile.gettempdir(), delete=False) as out:
                while part := source.read(1 << 20):
                    out.write(part)
            os.replace(out.name, local)
            _evict(os.path.dirname(local), os.path.basename(local))


def load(uri: str) -> tuple[dict[str, EliasFano | np.ndarray], dict]:
    """Maps a file that save() wrote. One in a store that cannot be mapped is fetched to the worker's own folder first."""
    from pyarrow import fs

    system, name = file_system(uri)
    data = np.asarray(np.memmap(name, np.uint8, "r") if isinstance(system, fs.LocalFileSystem) else _fetched(system, name))
    size = int.from_bytes(data[:8].tobytes(), "little")
    head = json.loads(data[8 : 8 + size].tobytes())
    arrays = {}
    for key, (at, kind, n) in head["arrays"].items():
        at += 8 + size
        arrays[key] = data[at : at + n * np.dtype(kind).itemsize].view(kind)
    parts: dict = {k: a for k, a in arrays.items() if "." not in k}
    for key, (n, bits) in head["sequences"].items():
        parts[key] = EliasFano(n, bits, *(arrays[f"{key}.{k}"] for k in ("high", "low", "ones")))
    return parts, head["facts"]
