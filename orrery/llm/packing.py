"""Best-fit packing of tokenised documents into sequences with several capacities.

A sequence has three capacities: tokens, documents, and attention cost. Attention within a piece is computed in square
tiles, so a piece of n tokens costs the square of ceil(n / tile); a piece of max_tokens costs nearly all that a sequence
has, and many short pieces cost more than one of as many tokens. Pieces go by falling length; each goes to the open sequence that is best under every constraint: by the
smallest weighted norm of what stays free (rule "norm", best fit), or by the largest weighted dot product of
the piece's demand with what is free (rule "dot"); a new sequence opens only if none has room.

A piece's demand follows from its length, so pieces of one length are alike, and the whole corpus is packed
exactly from its length histogram, which has at most max_tokens rows whatever the corpus' size. The driver
replays best fit on classes of sequences with equal residuals, many at once, and gives a table of steps: the
pieces of length L with ranks [a, b) fill sequences from s on, m in each, from offset o on. The workers number
the pieces of each length (in as many groups as the length's share of all pieces asks for) and look their step
up by rank. This is the same packing that one sequential pass over all pieces would give.

Defined results: a null text counts as empty and is one piece of one id (0); longer documents than max_tokens
are cut from the end into full pieces, so the first piece may be shorter; repeated rows are packed each; an
empty table gives an empty result; null ids are carried like others; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import text as tx
from orrery.llm.store import materialise
from orrery.skew import LEAST_PARTS

#: The step table is broadcast up to this many rows (48 bytes each), else joined by shuffle.
BROADCAST_STEPS = 200_000


#: A sequence's capacities beside its tokens: documents, and attention cost in tiles of TILE by TILE tokens, four more than
#: a piece of 2048 tokens costs, so that short pieces can still fill what long ones leave.
MAX_DOCS, TILE = 64, 128
MAX_COST = (2048 // TILE) ** 2 + 4


@lru_cache(maxsize=2)
def byte_bpe(json_name: str = "byte_bpe_50k.json", rank_name: str = "byte_bpe_50k.tiktoken"):
    """texts -> list of id lists, as the tokenizers file encodes them without added special tokens. Its ranks in
    tiktoken's core give the same ids several times faster; a text that spells out an added token goes to
    tokenizers itself."""
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(rank_name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    core = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    path = public_tokenizers.path(json_name)
    with open(path, encoding="utf-8") as f:
        added = [x["content"] for x in json.load(f)["added_tokens"]]
    full = Tokenizer.from_file(path)

    def encode(texts: list[str]) -> list[list[int]]:
        return [full.encode(t, add_special_tokens=False).ids if any(a in t for a in added) else core.encode_ordinary(t) for t in texts]

    return encode


def split_pieces(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], list[list[int]]]], max_tokens: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece int, start long, length long, ids_crc32 long, and with keep_ids the ids (little-endian
    unsigned 32-bit). A document is its ids and then end_id."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for rb in tx.chunks(batches, text_col, 4 << 20):
            rows, cols = [], [[] for _ in names[1:]]
            for i, ids in enumerate(encode([x or "" for x in rb.column(text_col).to_pylist()])):
                a = np.array([*ids, end_id], "<u4")
                cuts = [0, *range(len(a) % max_tokens or max_tokens, len(a) + 1, max_tokens)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    own = a[lo:hi].tobytes()
                    rows.append(i)
                    for c, v in zip(cols, (k, lo, hi - lo, zlib.crc32(own), own), strict=False):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([rb.column(id_col).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], names=names)

    read = docs.select(id_col, text_col)
    schema = f"doc_id {read.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return read.mapInArrow(run, schema)


def plan(histogram: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01), tile: int = 1) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Steps (length, rank from, rank to, first sequence, pieces in each, offset) and the number of sequences."""
    cap = np.array([max_tokens, max_docs, max_cost], np.float64)
    w = np.array(weights)
    free = np.zeros((1024, 3), np.int64)  # residual of each class of sequences
    alive = np.zeros(1024, bool)
    ranges: list[list[tuple[int, int]]] = []  # (first sequence, how many) of each class
    slot: dict[tuple[int, int, int], int] = {}
    steps, opened = [], 0

    def put(residual: tuple[int, int, int], first: int, n: int) -> None:
        nonlocal free, alive
        if residual[0] <= 0 or residual[1] <= 0 or residual[2] <= 0:
            return
        k = slot.get(residual)
        if k is None:
            k = slot[residual] = len(ranges)
            ranges.append([])
            if k == len(free):
                free, alive = np.vstack([free, np.zeros_like(free)]), np.append(alive, np.zeros_like(alive))
            free[k] = residual
        alive[k] = True
        ranges[k].append((first, n))

    for length in sorted(histogram, reverse=True):
        need = np.array([length, 1, (-(-length // tile)) ** 2], np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        left, rank = histogram[length], 0
        while left:
            fits = np.flatnonzero(alive[: len(ranges)] & (free[: len(ranges)] >= need).all(axis=1))
            if len(fits):
                rest = free[fits]
                score = -(w * (rest / cap) * (need / cap)).sum(1) if rule == "dot" else (w * ((rest - need) / cap) ** 2).sum(1)
                k = int(fits[np.argmin(score)])
                first, n = ranges[k].pop()
                alive[k] = bool(ranges[k])
                residual = free[k].copy()
            else:
                residual = cap.astype(np.int64)
                first, n = opened, -1
            # Under "norm" the sequence just chosen stays the best for its like; under "dot" its like goes elsewhere.
            each = int((residual // need).min()) if rule == "norm" or n < 0 else 1
            each = min(each, left)
            used = left // each if n < 0 else min(n, left // each)
            if n < 0:
                opened += used
            elif n > used:
                put(tuple(residual.tolist()), first + used, n - used)
            steps.append((length, rank, rank + used * each, first, each, max_tokens - int(residual[0])))
            put(tuple((residual - each * need).tolist()), first, used)
            rank += used * each
            left -= used * each
    return steps, opened


def pack(pieces: DataFrame, max_tokens: int = 2048, max_docs: int = MAX_DOCS, max_cost: int = MAX_COST, rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01), tile: int = TILE, rows_per_salt: int = 50_000) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32, ...) with sequence_id long and offset long."""
    spark = pieces.sparkSession
    pieces = materialise(pieces, "pack-pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_tokens rows at most
    steps, _ = plan(histogram, max_tokens, max_docs, max_cost, rule, weights, tile)
    by_length: dict[int, list] = {n: [] for n in histogram}
    for s in steps:
        by_length[s[0]].append(s[1:])
    share = max(1, sum(histogram.values()) // max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a task's even part of all pieces
    per = min(rows_per_salt, share)
    table = spark.createDataFrame([(n, -(-histogram[n] // per), v) for n, v in by_length.items()], "length long, _salts int, _steps array<struct<lo: long, hi: long, first: long, each: long, at: long>>")
    salted = pieces.join(F.broadcast(table.select("length", "_salts")), "length").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int")).drop("_salts")
    salted = materialise(salted.select(*pieces.columns, "_salt"), "pack-salted")
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", "_salt", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_own", own).join(bases, ["length", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_own") - 1)
    looked = table.select("length", "_steps")
    found = ranked.join(F.broadcast(looked) if len(steps) <= BROADCAST_STEPS else looked, "length")
    step = F.filter("_steps", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0]
    found = found.withColumn("_step", step)
    nth = F.col("_rank") - F.col("_step.lo")
    return found.select(*pieces.columns, (F.col("_step.first") + F.floor(nth / F.col("_step.each"))).cast("long").alias("sequence_id"), (F.col("_step.at") + nth % F.col("_step.each") * F.col("length")).cast("long").alias("offset"))


def op1_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(split_pieces(docs, byte_bpe))
