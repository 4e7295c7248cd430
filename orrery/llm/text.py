"""Word and shingle primitives on Arrow batches.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D]; bytes.split() without arguments cuts at
exactly these six bytes. Null texts count as empty. Every function works on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
U = np.uint64


class Vocab(dict):
    """Numbers its keys in the order in which they are first looked up."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most `limit` bytes of text, or one row."""
    for rb in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(rb.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < rb.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield rb.slice(start, end - start)
            start = end


def raw(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def tokenise(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Word numbers of all texts in a row, offsets of each text (one more than texts), and the distinct words."""
    vocab = Vocab()
    get = vocab.__getitem__
    offsets = np.zeros(len(texts) + 1, np.int64)
    parts = []
    for i, t in enumerate(texts):
        words = (t.translate(LOWER) if lower else t).split()
        offsets[i + 1] = offsets[i] + len(words)
        parts.append(np.fromiter(map(get, words), np.int32, len(words)))
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return ids, offsets, list(vocab)


def hash64(words: list[bytes]) -> np.ndarray:
    """64-bit keyed SipHash of each word."""
    if not words:
        return np.zeros(0, np.uint64)
    values = np.empty(len(words), object)
    values[:] = words
    return pd.util.hash_array(values, categorize=False)


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, np.uint64)
_BYTE_LOWER = _BYTE[np.frombuffer(LOWER, np.uint8)]
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BLOCK = 1 << 18


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base, and of its inverse modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in a row, and offsets of each text (one more than texts).

    A word's hash is the sum of a random number for each byte times a power of a base for its place, as differences of
    running sums over the whole buffer; then its length is mixed in. Two different words meet with a chance of about
    2 ** -64."""
    flat = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    inside = np.concatenate([[False], ~_SPACE[flat], [False]])
    turn = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = turn[::2], turn[1::2]
    table = _BYTE_LOWER if lower else _BYTE
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        z = max(a + 1, int(np.searchsorted(ends, starts[a] + BLOCK, side="right")))
        lo, hi = int(starts[a]), int(ends[z - 1])
        up, down = powers(hi - lo + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[flat[lo:hi]] * up[: hi - lo], out=sums[1:])
        own = starts[a:z] - lo
        out[a:z] = (sums[ends[a:z] - lo] - sums[own]) * down[own]
        a = z
    edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    return mix(out + (ends - starts).astype(np.uint64)), np.searchsorted(starts, edges)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """SplitMix64's finaliser: spreads every input bit over all 64."""
    x = x + U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def windows(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k-word window that lies within one text, and its first word's place."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += mix(hashes[j : n - k + 1 + j], j + 1)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= ends)
    return mix(out[at]), at


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text; a shorter text is one shingle, no word gives none."""
    hashes, offsets = word_hashes(texts)
    all_, at = windows(hashes, offsets, k)
    cut = np.searchsorted(at, offsets)
    out = []
    for i in range(len(texts)):
        n = offsets[i + 1] - offsets[i]
        if 0 < n < k:
            part = hashes[offsets[i] : offsets[i + 1]]
            out.append(mix(np.array([sum(int(x) for x in mix(part + mix(np.arange(n, dtype=np.uint64), 77))) & 0xFFFFFFFFFFFFFFFF], np.uint64), 1000 + int(n)))
        else:
            out.append(np.unique(all_[cut[i] : cut[i + 1]]))
    return out


def crc_mod(column: str, modulus: int):
    """crc32 of the id written as text, modulo `modulus`; a null id counts as empty text."""
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def schema_of(df, names: list[str], **new):
    """The fields `names` of df, and new ones by name and type."""
    from pyspark.sql import types as T

    return T.StructType([df.schema[n] for n in names] + [T.StructField(k, t) for k, t in new.items()])


def with_columns(rb: pa.RecordBatch, names: list[str], **new) -> pa.RecordBatch:
    arrays = [rb.column(n) for n in names] + [v if isinstance(v, (pa.Array, pa.ChunkedArray)) else pa.array(v) for v in new.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*names, *new])
