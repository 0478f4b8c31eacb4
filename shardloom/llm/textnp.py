"""Small numpy helpers that the operators of this subpackage use inside Spark tasks.

A task sees Arrow batches.  The text column of a batch is one UTF-8 buffer plus row offsets, so
words, hashes and n-grams of many documents are found by a handful of vector operations.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes handled at once; bounds a task's memory whatever the size of Spark's Arrow batches.
SLICE_BYTES = 2 << 20


_shipped: set[str] = set()


def ship_code(spark) -> None:
    """Let Python workers import this package: Spark sends its source files to them, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # The driver serves the file as long as it runs; nothing but the driver reads this folder.
    folder = tempfile.mkdtemp(prefix="shardloom-code-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "shardloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(package)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the int64 row offsets into them; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows with at most `limit` bytes of text (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64): a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = mix((np.arange(256, dtype=np.uint64) + U64(1)) * _BASE)
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def lower(buf: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[buf]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, at least n of each."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        for key, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[key] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of byte values times powers over [i, j), modulo 2**64."""
    up, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte spans; equal spans hash alike wherever they stand.  Where unequal spans must not meet, use `keyed_hash`."""
    _, down = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * _BASE)


_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)
_LONG = 256


def keyed_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes at a time through `mix`; spans over _LONG bytes by BLAKE2.

    Unlike `span_hash` it is no sum of powers, so texts with a repetitive structure don't meet by their structure.
    """
    size = end - start
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, 0, (1,))
    h = mix(size.astype(np.uint64) * _BASE + U64(key))
    live, at, left = np.flatnonzero((size > 0) & (size <= _LONG)), start, size
    if len(live) < len(size):
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=key.to_bytes(8, "little")).digest(), "little")
        at, left = start[live], size[live]
    while len(live):
        h[live] = mix((h[live] ^ (eight[at] & _KEEP[np.minimum(left, 8)])) * _BASE)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


class Words:
    """Runs of bytes other than space and 0x09-0x0D, in row order.

    start, end: byte positions; first: for each row the index of its first word (n + 1 entries).
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        word = ~_WS[buf]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        begin[inner] = word[inner]
        stop[inner - 1] = word[inner - 1]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def word_hashes(column: pa.Array) -> tuple[Words, np.ndarray]:
    """Words of a string column with A-Z lower-cased, and their 64-bit hashes."""
    buf, off = text_bytes(column)
    buf = lower(buf)
    words = Words(buf, off)
    return words, keyed_hash(buf, words.start, words.end)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingle hashes; fewer words give one, none none."""
    words, h = word_hashes(column)
    if len(h) >= k:
        s = h[: len(h) - k + 1] * _BASE
        for j in range(1, k):
            s = mix(s) + h[j : len(h) - k + 1 + j] * U64(2 * j + 3)
        s = mix(s)
    out = []
    for a, n in zip(words.first[:-1].tolist(), words.count.tolist(), strict=True):
        if n >= k:
            x = np.sort(s[a : a + n - k + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif n:
            x = U64(n)
            with np.errstate(over="ignore"):
                for w in h[a : a + n]:
                    x = mix(np.array([x], np.uint64))[0] + w * U64(5)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def reduce_rows(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] along the first axis; an empty run gives 0."""
    n = len(first) - 1
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = np.add.reduceat(values, first[full], axis=0)
    return out


def binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


class KeyIndex:
    """Positions of 64-bit keys: a slot table on the low bits, and a sorted list of keys that lost their slot."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys = keys
        self.mask = U64((1 << bits) - 1)
        self.slot = np.zeros(1 << bits, np.int32)
        low = (keys & self.mask).astype(np.int64)
        self.slot[low[::-1]] = np.arange(len(low), 0, -1)
        lost = np.flatnonzero(self.slot[low] != np.arange(1, len(low) + 1))
        self.lost = lost[np.argsort(keys[lost])]

    def find(self, h: np.ndarray) -> np.ndarray:
        """For each hash the position of its key, or -1."""
        at = self.slot[(h & self.mask).astype(np.int64)].astype(np.int64) - 1
        if not len(self.keys):
            return at
        taken = np.flatnonzero(at >= 0)
        other = taken[self.keys[at[taken]] != h[taken]]
        at[other] = -1
        if len(self.lost) and len(other):
            k = self.keys[self.lost]
            p = np.minimum(np.searchsorted(k, h[other]), len(k) - 1)
            hit = k[p] == h[other]
            at[other[hit]] = self.lost[p[hit]]
        return at
