"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct pre-tokens of a piece of the corpus (those that earlier pieces of the task have not had) are laid out as one
array of symbols. An inverted index
from symbol pair to the places where it stands is built once; then the merges are replayed in rank order:
the pair of the lowest rank is looked up, merged at all its places at once, and only the pairs with the two
neighbours of each place are indexed anew. A merge never makes a pair of a lower rank that could have come
first (every token of the vocabulary is reached through lower ranks), so this gives for every pre-token
what merging it alone gives. The ids of a text are the ids of its pre-tokens, one after another.

Defined results: a null text counts as empty and has no ids; texts of any length are encoded whole;
null and repeated ids are carried; repeated rows give repeated rows; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orrery.llm import text as tx

SHIFT = np.int64(1 << 20)


class Merges:
    """Token bytes by rank, and the rank of each pair of tokens that joins to another token."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in rows}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        keys, ranks = [], []
        for t, r in self.rank.items():
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    keys.append(a * int(SHIFT) + b)
                    ranks.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.pattern = regex.compile(pattern)

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        """-1 where the two tokens don't join."""
        at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[at] == pairs, self.ranks[at], -1)


@lru_cache(maxsize=4)
def merges_of(rank_file: str, pattern: str) -> Merges:
    return Merges(rank_file, pattern)


def replay(words: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in a row, and each word's offset."""
    size = np.array([len(w) for w in words], np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    n = int(offsets[-1])
    if not n:
        return np.zeros(0, np.int64), offsets
    symbol = np.append(m.byte[np.frombuffer(b"".join(words), np.uint8)], -1)  # the last place stands for "none"
    word = np.append(np.repeat(np.arange(len(words)), size), -1)
    after = np.arange(1, n + 2)
    after[n] = n
    before = np.arange(-1, n)
    before[0] = n
    after[:n][word[:n] != word[after[:n]]] = n
    before[:n][word[:n] != word[before[:n]]] = n
    whole = np.array([m.rank.get(w, -1) for w in words], np.int64)
    done = np.append(whole >= 0, False)[word[:n]] & (size[word[:n]] > 1)  # such words need no replay: their merges end in that token
    index: dict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[tuple[int, int]] = []

    def enter(places: np.ndarray) -> None:
        places = places[(places != n) & (after[places] != n)]
        pairs = symbol[places] * SHIFT + symbol[after[places]]
        ranks = m.rank_of(pairs)
        ok = ranks >= 0
        if not ok.any():
            return
        places, pairs, ranks = places[ok], pairs[ok], ranks[ok]
        order = np.argsort(pairs, kind="stable")
        places, pairs, ranks = places[order], pairs[order], ranks[order]
        cuts = np.flatnonzero(np.diff(pairs)) + 1
        for part, at in zip(np.split(places, cuts), [0, *cuts.tolist()], strict=True):
            pair = int(pairs[at])
            if pair not in index:
                heapq.heappush(queue, (int(ranks[at]), pair))
            index[pair].append(part)

    enter(np.flatnonzero(~done))
    while queue:
        rank, pair = heapq.heappop(queue)
        a, b = divmod(pair, int(SHIFT))
        found = index.pop(pair)
        places = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
        right = after[places]
        ok = (symbol[places] == a) & (right != n) & (symbol[right] == b)
        places, right = places[ok], right[ok]
        if a == b and len(places) > 1:  # in a run like aaa the left pair goes first
            places.sort()
            taken, keep = -1, []
            for p, q in zip(places.tolist(), after[places].tolist(), strict=True):
                keep.append(p != taken)
                taken = q if keep[-1] else -1
            places = places[np.array(keep)]
            right = after[places]
        if not len(places):
            continue
        beyond = after[right]
        symbol[places] = rank
        symbol[right] = -1
        after[places] = beyond
        before[beyond] = places
        before[n], after[n] = n, n
        enter(np.unique(np.concatenate([before[places], places])))
    starts = offsets[:-1][(whole >= 0) & (size > 1)]
    for_word = np.flatnonzero((whole >= 0) & (size > 1))
    alive = symbol[:n] >= 0
    alive[done] = False
    symbol[starts] = whole[for_word]
    alive[starts] = True
    counts = np.bincount(word[:n][alive], minlength=len(words))
    return symbol[:n][alive], np.concatenate([[0], np.cumsum(counts)])


def gather(flat: np.ndarray, offsets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The stretches `chosen` of flat, one after another."""
    lens = (offsets[1:] - offsets[:-1])[chosen]
    ends = np.cumsum(lens)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1][chosen] - (ends - lens), lens)]


class Replayed:
    """Pre-tokens that a task has replayed so far with their ids, up to `room` bytes of them; then it starts anew."""

    def __init__(self, m: Merges, room: int = 48 << 20):
        self.m, self.room = m, room
        self.clear()

    def clear(self) -> None:
        self.vocab, self.held = tx.Vocab(), 0
        self.flat, self.offsets = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids (little-endian unsigned 32-bit) of each text."""
        if self.held > self.room:
            self.clear()
        get, chosen, known = self.vocab.__getitem__, [], len(self.vocab)
        for t in texts:
            words = self.m.pattern.findall(t)
            chosen.append(np.fromiter(map(get, words), np.int32, len(words)))
        new = [w.encode() for w in islice(self.vocab, known, None)]
        flat, offsets = replay(new, self.m)
        self.flat = np.concatenate([self.flat, flat.astype("<u4")])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + offsets[1:]])
        self.held += 100 * len(new) + sum(map(len, new)) + flat.nbytes
        return [gather(self.flat, self.offsets, c) for c in chosen]


def encode_texts(texts: list[str], m: Merges) -> list[np.ndarray]:
    return Replayed(m).encode(texts)


def decode(ids: np.ndarray, m: Merges) -> bytes:
    return b"".join(map(m.token.__getitem__, ids.tolist()))


def bpe_encode(docs: DataFrame, rank_file: str | Callable[[], str], pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens long, and ids binary (little-endian unsigned 32-bit) with decoded binary, or their digests.
    rank_file: a path that every worker has, or a function that gives it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges_of(rank_file() if callable(rank_file) else rank_file, pattern)
        done = Replayed(m)
        for rb in tx.chunks(batches, text_col, 8 << 20):
            ids = done.encode([x or "" for x in rb.column(text_col).to_pylist()])
            counts = pa.array([len(x) for x in ids], pa.int64())
            if digests:
                out = [pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(decode(x, m)).hexdigest() for x in ids])]
            else:
                out = [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([decode(x, m) for x in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays([rb.column(id_col), counts, *out], names=["doc_id", "n_tokens", *names])

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kind = "string" if digests else "binary"
    read = docs.select(id_col, text_col)
    return read.mapInArrow(run, f"doc_id {read.schema[id_col].dataType.simpleString()}, n_tokens long, {names[0]} {kind}, {names[1]} {kind}")


def public_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op10_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_encode(docs, public_ranks, public_tokenizers.PATTERN, digests=True)
