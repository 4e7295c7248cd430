"""Language-model scoring with a log-frequency Bloom filter.

Counting: each piece of the training texts gives its distinct words, word pairs and word triples with counts, dealt by
hash into buckets; a bucket's group adds them up. An n-gram that stands in a third of all texts is one entry for
each piece, so no group grows with one key. The counts are written to the shared folder.

Model: pairs and triples enter a Bloom filter once for each level of their quantised count (level 1: a count of 1,
level j: at least 2 * base ** (j - 2)); all probes of one entry fall into one 64-bit word. The filter is cut into
segments by bucket, and word counts stay exact. All of it is broadcast in shards of at most about shard_bytes, each a
range of buckets: while there is one shard a worker keeps it; beyond, it reads shard after shard for each group of
pieces, so memory stays bounded at any corpus size.

Scoring: P(w|gh) = L3 c(ghw) / c(gh) + L2 c(hw) / c(h) + L1 (c(w) + 1) / (N + V + 1), with c(ghw), c(gh) and c(hw)
read off by probing levels until one is missing (a value above the counts of its parts is a false positive and counts
as 0). The weights go by log2 c(gh), or by log2 c(h) where gh was never seen, and are estimated by EM with
leave-one-out counts on all training documents. A token enters EM by its class and the ratios of its three
probabilities alone, so one pass counts the tokens by class and quarter octaves of the ratios; the rounds run on
these cells, whose number is bounded.

Tokens are words with A-Z lower-cased, then one end; a text's first history is a start mark that is not
counted. Words are told apart by 64-bit hashes. Defined results: a null text counts as empty (its end alone is
scored); texts are scored whole; ids, null or repeated, are carried and say nothing; without training texts every
count is 0; repeated rows give repeated rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from orrery.llm import text as tx
from orrery.llm.store import drop, materialise

U = np.uint64
END, START = tx.mix(np.array([1, 2], np.uint64), 12345)  # hashes of the marks
WORDS, PAIRS, TRIPLES = 1, 2, 3
PROBES = 4  # bits in an entry's 64-bit word
CLASSES = 128  # the upper half: pairs that were seen
PLACES, EVEN = 256, 96  # of a ratio: quarter octaves from 2 ** -24 to 2 ** 40, EVEN for 1; place 0 stands for a ratio of 0
FIRST = np.array([[0.8, 0.2, 0.0], [0.5, 0.25, 0.25]])  # weights before EM, without and with a history of two words


@dataclass
class Shard:
    """Word counts and filter segments of the buckets from lo to hi - 1."""

    lo: int
    hi: int
    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    bits: dict  # by kind: 64-bit words of all segments
    starts: dict  # by kind: where each bucket's segment starts, and the end


@dataclass
class Model:
    n_buckets: int
    total: int = 0  # N
    distinct: int = 0  # V
    shards: list = field(default_factory=list)  # broadcasts
    base: float = 1.5
    bits_per_entry: int = 12
    mix: np.ndarray = field(default_factory=lambda: np.repeat(FIRST, CLASSES // 2, axis=0))  # L1, L2, L3 by class

    def release(self) -> None:
        """Takes the model from the executors; it is sent again if something still asks for it."""
        for sent in self.shards:
            sent.unpersist()


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Buckets are ranges of the hash, so sorted keys stand bucket by bucket."""
    return ((keys >> U(32)) * U(n) >> U(32)).astype(np.int64)


@dataclass
class Tokens:
    """The tokens of a piece: distinct keys (sorted) of each kind, the place of each token's own among them, and of its history's."""

    lens: np.ndarray  # tokens of each text
    keys: dict
    word: np.ndarray
    history: np.ndarray  # place of the word before; -1 for the start
    pair: np.ndarray
    before: np.ndarray  # place of the pair that ends with the word before; -1 without one
    triple: np.ndarray  # -1 without one


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends of all texts in a row, and each text's number of them."""
    words, offsets = tx.word_hashes(texts)
    lens = np.diff(offsets)
    n = len(texts)
    out = np.full(len(words) + n, END)
    out[np.arange(len(words)) + np.repeat(np.arange(n), lens)] = words
    return out, lens + 1


def chain(own: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair hash of each token with the one before (or the start), triple hash (of tokens with two before or the start
    and one), and which tokens are first in their text."""
    first = np.zeros(len(own), bool)
    first[np.cumsum(lens)[:-1]] = True
    first[:1] = True
    before = np.concatenate([[START], own[:-1]]) if len(own) else own
    before = np.where(first, START, before)
    pair = tx.mix(tx.mix(before, 3) + own)
    triple = tx.mix(tx.mix(np.concatenate([pair[:1], pair[:-1]]), 4) + own)
    return pair, triple, first


def read_tokens(texts: list[bytes]) -> Tokens:
    own, lens = token_hashes(texts)
    pair, triple, first = chain(own, lens)
    keys, places = {}, {}
    for kind, values in ((WORDS, own), (PAIRS, pair), (TRIPLES, triple[~first])):
        keys[kind], at = np.unique(values, return_inverse=True)
        places[kind] = at.astype(np.int32)
    late = np.full(len(own), -1, np.int32)
    late[~first] = places[TRIPLES]
    shift = lambda v: np.where(first, np.int32(-1), np.concatenate([v[:1], v[:-1]]))
    return Tokens(lens, keys, places[WORDS], shift(places[WORDS]), places[PAIRS], shift(places[PAIRS]), late)


def count_pieces(docs: DataFrame, n_buckets: int, text_col: str = "text") -> DataFrame:
    """A row for each bucket, kind and piece of text: keys seen once and counts of the others. Words have 64-bit keys, the
    rest the lower half: the upper half says the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tx.chunks(batches, text_col, 8 << 20):
            own, lens = token_hashes(tx.raw(rb.column(text_col)))
            pair, triple, first = chain(own, lens)
            for kind, values in ((WORDS, own), (PAIRS, pair), (TRIPLES, triple[~first])):  # a batch a kind
                rows: list[list] = [[] for _ in range(5)]
                keys, counts = np.unique(values, return_counts=True)
                where = bucket_of(keys, n_buckets)
                cut = np.flatnonzero(np.concatenate([[True], np.diff(where) != 0, [True]])) if len(keys) else np.zeros(1, np.int64)
                short, counts, once = keys if kind == WORDS else keys.astype(np.uint32), counts.astype(np.uint32), counts == 1
                for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own_keys, o = short[a:z], once[a:z]
                    for c, v in zip(rows, (int(where[a]), kind, own_keys[o].tobytes(), own_keys[~o].tobytes(), counts[a:z][~o].tobytes()), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int8()), *(pa.array(c, pa.binary()) for c in rows[2:])], names=["bucket", "kind", "once", "more", "counts"])

    return docs.select(text_col).mapInArrow(run, "bucket int, kind byte, once binary, more binary, counts binary")


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return np.where(counts < 2, 1, 2 + np.floor(np.log(np.maximum(counts, 2) / 2) / np.log(base) + 1e-9).astype(np.int64))


def level_count(level: int, base: float) -> int:
    """The least count of a level, rounded down."""
    return 1 if level == 1 else int(np.floor(2 * base ** (level - 2) + 1e-9))


def probe(short: np.ndarray, kind: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For keys at a level: a hash that chooses the word (32 bits), and the bits to be set in it."""
    g = tx.mix(short, 1000 * kind + level)
    bits = np.zeros(len(g), np.uint64)
    for i in range(PROBES):
        bits |= U(1) << ((g >> U(6 * i)) & U(63))
    return g >> U(32), bits


def segment(short: np.ndarray, counts: np.ndarray, kind: int, m: Model, block: int = 1 << 16) -> np.ndarray:
    """A bucket's part of the filter, made from `block` keys at a time."""
    cut = [slice(a, a + block) for a in range(0, len(short), block)]
    size = sum(int(levels(counts[at], m.base).sum()) for at in cut)
    out = np.zeros(max(1, -(-size * m.bits_per_entry // 64)), np.uint64)
    for at in cut:
        own, level = short[at].astype(np.uint64), levels(counts[at], m.base)
        for j in range(1, int(level.max(initial=0)) + 1):
            where, bits = probe(own[level >= j], kind, j)
            np.bitwise_or.at(out, (where * U(len(out)) >> U(32)).astype(np.int64), bits)
    return out


def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of all rows of a binary column, one after another."""
    return np.frombuffer(b"".join(v.as_buffer() for chunk in column.chunks for v in chunk), kind)


def sums_of_words(once: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys, sorted, with the sums of their counts."""
    keys = np.concatenate([once, more])
    n = np.concatenate([np.ones(len(once), np.int64), counts.astype(np.int64)])
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
    return keys[first], np.add.reduceat(n, first)


def sums_of_short(once: np.ndarray, more: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for 32-bit keys: each stands above its count in one number, which is sorted in its place."""
    held = np.empty(len(once) + len(more), np.uint64)
    held[: len(once)], held[len(once) :] = once, more
    held <<= U(32)
    held[: len(once)] |= U(1)
    held[len(once) :] |= counts
    held.sort()
    keys = (held >> U(32)).astype(np.uint32)
    held &= U(0xFFFFFFFF)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(held, first).astype(np.int64)


def add_up(pieces: DataFrame, m: Model) -> DataFrame:
    """bucket, kind, n (distinct keys), total, keys (of words: hashes; else: the filter's segment), counts (of words)."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        width, sums = (np.uint64, sums_of_words) if kind == WORDS else (np.uint32, sums_of_short)
        keys, counts = sums(joined(table.column("once"), width), joined(table.column("more"), width), joined(table.column("counts"), np.uint32))
        n, total = len(keys), int(counts.sum())
        if kind != WORDS:
            keys, counts = segment(keys, counts, kind, m), counts[:0]
        cols = [table.column("bucket")[0].as_py(), kind, n, total, keys.tobytes(), counts.tobytes()]
        kinds = [pa.int32(), pa.int8(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([c], t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "kind", "n", "total", "keys", "counts"])

    return pieces.groupBy("bucket", "kind").applyInArrow(run, "bucket int, kind byte, n long, total long, keys binary, counts binary")


def make_shard(rows: list, lo: int, hi: int) -> Shard:
    rows = sorted(rows, key=lambda r: r["bucket"])
    join = lambda parts, t: np.frombuffer(b"".join(parts), t)
    words = join([r["keys"] for r in rows if r["kind"] == WORDS], np.uint64)
    counts = join([r["counts"] for r in rows if r["kind"] == WORDS], np.int64)
    bits, starts = {}, {}
    for kind in (PAIRS, TRIPLES):
        sizes = np.zeros(hi - lo, np.int64)
        for r in rows:
            if r["kind"] == kind:
                sizes[r["bucket"] - lo] = len(r["keys"]) // 8
        bits[kind], starts[kind] = join([r["keys"] for r in rows if r["kind"] == kind], np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    return Shard(lo, hi, words, counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64), bits, starts)


def look_up(shard: Shard, m: Model, kind: int, keys: np.ndarray, out: np.ndarray) -> None:
    """Writes what the shard knows of the sorted keys in its buckets to out: counts of words (int64), else levels (uint8)."""
    bucket = bucket_of(keys, m.n_buckets)
    a, z = np.searchsorted(bucket, [shard.lo, shard.hi])
    if a == z:
        return
    if kind == WORDS:
        if len(shard.words):
            at = np.minimum(np.searchsorted(shard.words, keys[a:z]), len(shard.words) - 1)
            out[a:z] = np.where(shard.words[at] == keys[a:z], shard.counts[at], 0)
        return
    starts, own = shard.starts[kind], bucket[a:z] - shard.lo
    first, size = starts[own], (starts[own + 1] - starts[own]).astype(np.uint64)
    alive, short = np.flatnonzero(size > 0), keys[a:z] & U(0xFFFFFFFF)
    first, size, short, level = first[alive], size[alive], short[alive], 0
    while len(alive):
        level += 1
        where, bits = probe(short, kind, level)
        hit = shard.bits[kind][first + (where * size >> U(32)).astype(np.int64)] & bits == bits
        alive, first, size, short = alive[hit], first[hit], size[hit], short[hit]
        out[a:z][alive] = level


def counts_of(pieces: list[Tokens], m: Model) -> list[dict]:
    """By piece and kind: what look_up says of the distinct keys. Shards are read one after another, each for all the pieces."""
    out = [{k: np.zeros(len(v), np.int64 if k == WORDS else np.uint8) for k, v in p.keys.items()} for p in pieces]
    for sent in m.shards:
        for p, found in zip(pieces, out, strict=True):
            for kind, keys in p.keys.items():
                look_up(sent.value, m, kind, keys, found[kind])
        if len(m.shards) > 1:
            sent.__dict__.pop("_value", None)  # one shard in memory at a time
    return out


def statistics(p: Tokens, found: dict, m: Model) -> dict[str, np.ndarray]:
    """For each token: c(w), c(h), c(hw), c(gh), c(ghw). As many starts are counted as ends."""
    count = np.array([0, *(level_count(j, m.base) for j in range(1, 100))], np.int64)
    end = int(found[WORDS][np.searchsorted(p.keys[WORDS], END)]) if len(p.lens) else 0
    w = found[WORDS][p.word]
    h = np.where(p.history < 0, end, found[WORDS][p.history])
    hw = count[found[PAIRS][p.pair]]
    gh = np.where(p.before < 0, 0, count[found[PAIRS][p.before]])
    ghw = np.where(p.triple < 0, 0, count[found[TRIPLES][p.triple]]) if len(found[TRIPLES]) else np.zeros(len(w), np.int64)
    hw = np.where(hw > np.minimum(w, h), 0, hw)
    gh = np.where(gh > h, 0, gh)
    return {"w": w, "h": h, "hw": hw, "gh": gh, "ghw": np.where(ghw > np.minimum(hw, gh), 0, ghw)}


def parts(c: dict, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each token's history, and its probability by words, pairs and triples."""
    seen = c["gh"] > 0
    kind = np.where(seen, CLASSES // 2, 0) + np.log2(np.maximum(np.where(seen, c["gh"], c["h"]), 1)).astype(np.int64)
    share = lambda a, b: np.minimum(1, a / np.maximum(b, 1))
    return kind, (c["w"] + 1) / (m.total + m.distinct + 1), share(c["hw"], c["h"]), share(c["ghw"], c["gh"])


def grouped(batches: Iterator[pa.RecordBatch], m: Model, text_col: str) -> Iterator[list[tuple[pa.RecordBatch, Tokens]]]:
    """Pieces of at most 2 MB of text, several at once if there are several shards to read for them."""
    room, held, out = 1 if len(m.shards) <= 1 else 8 << 20, 0, []
    for rb in tx.chunks(batches, text_col, 2 << 20):
        out.append((rb, read_tokens(tx.raw(rb.column(text_col)))))
        held += rb.column(text_col).nbytes
        if held >= room:
            yield out
            held, out = 0, []
    if out:
        yield out


def mix_cells(train: DataFrame, m: Model, text_col: str = "text") -> DataFrame:
    """cell int (class, place of the pair's and of the triple's probability against the word's), n long (tokens): a row for
    each cell and task. Each token's own count is taken from its counts."""

    def place(p: np.ndarray, p1: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), np.int64)
        own = np.flatnonzero(p > 0)
        out[own] = np.clip(np.rint(4 * np.log2(p[own] / p1[own])) + EVEN, 1, PLACES - 1)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for group in grouped(batches, m, text_col):
            tokens = [p for _, p in group]
            for p, found in zip(tokens, counts_of(tokens, m), strict=True):
                c = {k: np.maximum(v - 1, 0) for k, v in statistics(p, found, m).items()}
                kind, p1, p2, p3 = parts(c, m)
                new, more = np.unique((kind * PLACES + place(p2, p1)) * PLACES + place(p3, p1), return_counts=True)
                cells, at = np.unique(np.concatenate([cells, new]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, more])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(n)], names=["cell", "n"])

    return train.select(text_col).mapInArrow(run, "cell int, n long")


def fit_mix(train: DataFrame, m: Model, text_col: str = "text", rounds: int = 15) -> np.ndarray:
    """Weights of words, pairs and triples by class, by EM on all training texts."""
    found = mix_cells(train, m, text_col).groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # classes by places of ratios at most
    cell, n = (found.column(c).to_numpy().astype(np.int64) for c in ("cell", "n"))
    order = np.argsort(cell)
    cell, n = cell[order], n[order]
    kind = cell // PLACES**2
    ratio = np.ones((len(cell), 3))
    for k, place in ((1, cell // PLACES % PLACES), (2, cell % PLACES)):
        ratio[:, k] = np.where(place > 0, 2.0 ** ((place - EVEN) / 4), 0)
    return weights_by_em(kind, ratio, n, rounds)


def weights_by_em(kind: np.ndarray, ratio: np.ndarray, n: np.ndarray, rounds: int = 15) -> np.ndarray:
    """n tokens of class kind whose three probabilities stand to each other as ratio. Every class starts with ten tokens'
    worth of the first weights; words keep a thousandth at least."""
    first = np.repeat(FIRST, CLASSES // 2, axis=0)
    out = first
    for _ in range(rounds):
        a = out[kind] * ratio
        a *= (n / a.sum(1))[:, None]
        got = np.stack([np.bincount(kind, a[:, k], minlength=CLASSES) for k in range(3)], axis=1) + 10 * first
        out = got / got.sum(1, keepdims=True)
        out[:, 0] = np.maximum(out[:, 0], 1e-3)
        out /= out.sum(1, keepdims=True)
    return out


def fit(train: DataFrame, text_col: str = "text", base: float = 1.5, bits_per_entry: int = 12, shard_bytes: int = 24 << 20, bucket_bytes: int = 8 << 20) -> Model:
    """Counts all training texts and sends out the model."""
    spark = train.sparkSession
    size = train.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    m = Model(max(12, -(-size // bucket_bytes)), base=base, bits_per_entry=bits_per_entry)
    counts = materialise(add_up(count_pieces(train, m.n_buckets, text_col), m), "lm-counts")
    words = F.col("kind") == WORDS
    own = counts.agg(
        F.sum(F.when(words, F.col("n"))).alias("v"), F.sum(F.when(words, F.col("total"))).alias("t"),
        F.sum(F.when(words, 1.5 * F.octet_length("keys")).otherwise(F.octet_length("keys"))).alias("b")).first()
    m.total, m.distinct = own["t"] or 0, own["v"] or 0
    n = min(m.n_buckets, max(1, -(-int(own["b"] or 0) // shard_bytes)))  # buckets go by hash, so equal ranges are of like size
    cuts = [m.n_buckets * i // n for i in range(n + 1)]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        held = counts.filter(F.col("bucket").between(lo, hi - 1)).select("bucket", "kind", "keys", "counts")
        m.shards.append(spark.sparkContext.broadcast(make_shard(list(held.toLocalIterator()), lo, hi)))
    drop(counts)
    m.mix = fit_mix(train, m, text_col)
    return m


def score_tokens(p: Tokens, found: dict, m: Model) -> dict[str, np.ndarray]:
    c = statistics(p, found, m)
    kind, p1, p2, p3 = parts(c, m)
    weight = np.where((c["h"] > 0)[:, None], m.mix[kind], [1.0, 0, 0])
    starts = np.concatenate([[0], np.cumsum(p.lens)])[:-1]
    add = lambda v: np.add.reduceat(v, starts) if len(p.lens) else np.zeros(0)
    mixed = weight[:, 0] * p1 + weight[:, 1] * p2 + weight[:, 2] * p3
    return {"n_tokens": p.lens, "n_known": add((c["w"] > 0).astype(np.int64)), "base_score": add(np.log10(p1)), "score": add(np.log10(mixed))}


def score(docs: DataFrame, m: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with n_tokens, n_known, base_score, score."""
    new = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    names = [c for c in (keep if keep is not None else docs.columns) if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, m, text_col):
            for (rb, p), found in zip(group, counts_of([p for _, p in group], m), strict=True):
                got = score_tokens(p, found, m)
                yield tx.with_columns(rb, names, **{k: pa.array(got[k], t) for k, t in new.items()})

    read = docs.select(*dict.fromkeys([*names, text_col]))
    return read.mapInArrow(run, tx.schema_of(read, names, n_tokens=LongType(), n_known=LongType(), base_score=DoubleType(), score=DoubleType()))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = tx.crc_mod("doc_id", 7) == 2
    m = fit(docs.filter(~held_out))
    scored = materialise(score(docs, m, keep=["doc_id"]), "lm-scores")  # small rows; then the model can leave the executors
    m.release()
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(m.total).cast("long").alias("train_tokens"), "base_score", "score")


def lm_base(spark, sf_dir: str) -> DataFrame:
    """What op3_lm_score says of every document without pairs and triples; base_score to three places."""
    return op3_lm_score(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


#: crc32 of a short text, by a table that SQL builds.
CRC_SQL = """RECURSIVE crc_steps(n, c, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS l FROM crc_steps WHERE k = 8),
parts AS (
  SELECT d.*, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(l[xor(a & 255, b) + 1], a >> 8))) AS crc
  FROM documents d, crc_table)"""

BASE_SQL = rf"""
WITH {CRC_SQL},
w AS (
  SELECT doc_id, crc % 7 = 2 AS held_out,
    unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10))) AS word
  FROM parts),
c AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY word),
n AS (SELECT coalesce(sum(c), 0) AS total, count(*) AS distinct_ FROM c)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(total)::BIGINT AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 1) / (total + distinct_ + 1))), 3) AS base_score
FROM w LEFT JOIN c USING (word), n GROUP BY doc_id, held_out
"""
