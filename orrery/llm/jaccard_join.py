"""N-gram Jaccard join with token-combination prefixes, and the groups that its links make.

A document's set is its distinct k-word shingles (64-bit hashes). Two sets link when their Jaccard similarity
is at least `percent` hundredths. Sets that are equal are one node (by a 64-bit fingerprint of the set).

1. Document frequencies: each piece of text gives its distinct shingles with counts by hash bucket; a bucket
   adds them up, so one shingle costs one entry a piece, however many documents have it. What comes back is a
   Bloom filter with two levels: shingles of two documents or more, and frequent ones. It is sent out in shards
   of bounded size, of which a worker holds one at a time if there are several. Where it errs it takes a shingle
   for more frequent than it is, alike for every document; results don't change.
2. Prefixes: shingles are ordered by class (of one document, rare, frequent) and hash. A set r has a partner
   only if at most t = |r| - ceil(percent |r| / 100) of its shingles are missing there. The prefix is extended
   until more than t missing shingles would be needed to leave no signature in common: a shingle of one
   document is always missing, a rare one is a signature by itself, and frequent ones are dealt by hash into
   subclasses whose pairs are the signatures, so x of them in a subclass need x - 1 missing. The number of
   subclasses follows the size band; a set uses its own band and those of possible partners. A set whose prefix
   holds only shingles of one document has no partner and goes no further.
3. Verification, exact, on whole sets. First each set against the leader of most of its signatures' lists;
   what links there makes components. Then only lists that hold several components are left: the sets of all
   such lists with one leader are cut into blocks, and each two blocks are compared at once, by counting common
   shingles as a matrix product. A pair of blocks returns the few links that join components, never all its
   pairs, and sets of one component, which further links cannot change, are not told apart again.

Defined results: a null text is empty; an empty set links with nothing and is its own component; repeated rows
are equal sets; the component of rows whose ids are null has the least other id, or null; an empty table gives
an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import text as tx
from orrery.llm.exact_dedup import ONCE, row_hash
from orrery.llm.marks import marked
from orrery.llm.store import drop, materialise
from orrery.operators.components import least_labels
from orrery.skew import hot_keys, salted_join

U = np.uint64
PROBES = 5


def bucket_bits(docs: DataFrame, text_col: str, bucket_bytes: int) -> int:
    """Bits of the bucket number: buckets of about bucket_bytes of text, 2 ** 22 of them at most."""
    size = docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return int(np.clip(np.ceil(np.log2(max(1, size / bucket_bytes))), 4, 22))


def cut_key(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of a hash (its first bits), and the next 32 bits."""
    return (h >> U(64 - bits)).astype(np.int64), ((h >> U(32 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)


def probe_places(keys: np.ndarray, level: int, i: int, size: np.ndarray) -> np.ndarray:
    g = tx.mix(keys.astype(np.uint64), 50 + level)
    return (((g & U(0xFFFFFFFF)) + U(i) * ((g >> U(32)) | U(1))) % size.astype(np.uint64)).astype(np.int64)


def frequency_filter(docs: DataFrame, k: int, text_col: str, bits: int, frequent: int, max_bytes: int, shard_bytes: int) -> list:
    """Broadcast shards (first bucket, end, bytes, first bit and size in bits by bucket) of the two-level filter: max_bytes
    together at most, shard_bytes each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tx.chunks(batches, text_col):
            sets = tx.shingle_sets(tx.raw(rb.column(text_col)), k)
            keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
            bucket, short = cut_key(keys, bits)  # sorted hashes: buckets are stretches
            cut = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(bucket) else np.zeros(1, np.int64)
            rows: list[list] = [[], [], [], []]
            for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                own, n = short[a:z], counts[a:z].astype(np.uint32)
                for c, v in zip(rows, (int(bucket[a]), own[n == 1].tobytes(), own[n > 1].tobytes(), n[n > 1].tobytes()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["bucket", "ones", "more", "counts"])

    def add_up(table: pa.Table) -> pa.Table:
        join = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint32)
        ones, more = join("ones"), join("more")
        keys = np.concatenate([ones, more])
        counts = np.concatenate([np.ones(len(ones), np.int64), join("counts").astype(np.int64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys) != 0]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        entries = int((counts > 1).sum() + (counts >= frequent).sum())
        size = -(-int(np.clip(10 * entries, 64, max(64, max_bytes * 8 >> bits))) // 8) * 8
        out = np.zeros(size, np.uint8)
        for level, least in ((1, 2), (2, frequent)):
            own = keys[counts >= least]
            for i in range(PROBES):
                out[probe_places(own, level, i, np.full(len(own), size))] = 1
        return pa.table([pa.array([table.column("bucket")[0].as_py()], pa.int32()), pa.array([np.packbits(out, bitorder="little").tobytes()], pa.binary())], names=["bucket", "filter"])

    pieces = docs.select(text_col).mapInArrow(count, "bucket int, ones binary, more binary, counts binary")
    table = materialise(pieces.groupBy("bucket").applyInArrow(add_up, "bucket int, filter binary"), "jaccard-filter")
    held = table.agg(F.sum(F.octet_length("filter")).alias("n")).first()["n"] or 0
    cuts = np.linspace(0, 1 << bits, min(1 << bits, max(1, -(-held // shard_bytes))) + 1).astype(int).tolist()  # buckets go by hash, so equal ranges are of like size
    ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
    out = []
    for lo, hi in ranges:
        found = {r["bucket"]: np.frombuffer(r["filter"], np.uint8) for r in table.filter(F.col("bucket").between(lo, hi - 1)).toLocalIterator()}
        parts = [found.get(b, np.zeros(8, np.uint8)) for b in range(lo, hi)]
        sizes = np.array([len(x) * 8 for x in parts], np.int64)
        out.append(docs.sparkSession.sparkContext.broadcast((lo, hi, np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)))
    drop(table)
    return out


def classes(tokens: np.ndarray, bits: int, shards: list) -> np.ndarray:
    """0: one document's, 1: rare, 2: frequent."""
    bucket, short = cut_key(tokens, bits)
    out = np.zeros(len(tokens), np.int8)
    for sent in shards:
        lo, hi, flat, starts, sizes = sent.value
        alive = np.flatnonzero((bucket >= lo) & (bucket < hi)) if len(shards) > 1 else np.arange(len(tokens))
        for level in (1, 2):
            for i in range(PROBES):
                b = bucket[alive] - lo
                at = starts[b] + probe_places(short[alive], level, i, sizes[b])
                alive = alive[(flat[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            out[alive] = level
        if len(shards) > 1:
            sent.__dict__.pop("_value", None)  # one shard in memory at a time
    return out


def bands(n: int, percent: int) -> range:
    """Size bands (powers of two) of the sizes that a partner of a set of n can have."""
    return range(int(-(-percent * n // 100)).bit_length() - 1, int(100 * n // percent).bit_length())


def signatures(tokens: np.ndarray, kind: np.ndarray, percent: int) -> np.ndarray | None:
    """Signatures of a set (hashes), or None if it cannot have a partner with another set."""
    n = len(tokens)
    need = n + percent * n // -100 + 1  # one more than the shingles that may be missing
    need -= int((kind == 0).sum())
    if n == 0 or need <= 0:
        return None
    rare = tokens[kind == 1][:need]
    need -= len(rare)
    out = [tx.mix(rare, 1)]
    if need > 0:
        often = tokens[kind == 2]
        for band in bands(n, percent):
            if band < 4:
                out.append(tx.mix(often[:need], 1))
                continue
            parts = 1 << (band - 3)
            group = (tx.mix(often, 2) % U(parts)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            later = np.zeros(len(often), bool)  # not the first of its subclass
            later[order[1:]] = np.diff(group[order]) == 0
            end = int(np.searchsorted(np.cumsum(later), need)) + 1
            used, of = often[:end], group[:end]
            by = np.argsort(of, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(of[by])) + 1):
                if len(own) > 1:
                    i, j = (np.array(x) for x in zip(*combinations(sorted(own.tolist()), 2), strict=True))
                    out.append(tx.mix(tx.mix(used[i], 3) + used[j], 100 + band))
    return np.unique(np.concatenate(out))


def sketch(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, bits: int, shards: list) -> DataFrame:
    """doc_id, n int, node long, and for sets that can have a partner sigs array<long> and toks binary (the
    shingles of two documents or more: only these can be common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tx.chunks(batches, text_col, 4 << 20):
            sets = tx.shingle_sets(tx.raw(rb.column(text_col)), k)
            kinds = classes(np.concatenate([np.zeros(0, np.uint64), *sets]), bits, shards)
            at, nodes, sigs, toks = 0, [], [], []
            for s in sets:
                nodes.append(tx.mix(np.array([int(np.bitwise_xor.reduce(tx.mix(s, 5))) ^ len(s)], np.uint64) + np.sum(tx.mix(s, 6)), 7)[0])
                kind = kinds[at : at + len(s)]
                own = signatures(s, kind, percent)
                at += len(s)
                sigs.append(None if own is None else own.view(np.int64))
                toks.append(None if own is None else s[kind > 0].tobytes())
            cols = [rb.column(id_col), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sigs, pa.list_(pa.int64())), pa.array(toks, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "node", "sigs", "toks"])

    read = docs.select(id_col, text_col)
    return read.mapInArrow(run, f"doc_id {read.schema[id_col].dataType.simpleString()}, n int, node long, sigs array<long>, toks binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int, tag: str) -> DataFrame:
    """The pairs (a, b) of a table that link, written down; a may be one node in many of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            both = []
            for x, y in zip(rb.column("x").to_pylist(), rb.column("y").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both.append(int((y[at] == x).sum()))
            yield pa.RecordBatch.from_arrays([*(rb.column(c) for c in ("a", "b", "na", "nb")), pa.array(both, pa.int32())], names=["a", "b", "na", "nb", "both"])

    left, right = (sets.select(F.col("node").alias(i), F.col("n").alias("n" + i), F.col("toks").alias(t)) for i, t in (("a", "x"), ("b", "y")))
    done = salted_join(pairs.select("a", "b"), left, ["a"]).join(right, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na int, nb int, both int")
    return materialise(done.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"), tag)


def common(left: list[np.ndarray], right: list[np.ndarray], dense: int = 8, width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each left with each right set: shingles of many sets by matrix products, the
    others by listing the sets that have them."""
    tokens = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, col, times = np.unique(tokens, return_inverse=True, return_counts=True)
    out = np.zeros((len(left), len(right)), np.float32)
    many = np.flatnonzero(times > dense)
    place = np.full(len(times), -1, np.int64)
    place[many] = np.arange(len(many))
    at = place[col]
    for start in range(0, len(many), width):
        own = (at >= start) & (at < start + width)
        member = np.zeros((len(left) + len(right), min(width, len(many) - start)), np.float32)
        member[row[own], at[own] - start] = 1
        out += member[: len(left)] @ member[len(left) :].T
    few = np.flatnonzero((at < 0) & (times[col] > 1))
    few = few[np.argsort(col[few], kind="stable")]
    c, r = col[few], row[few]
    for step in range(1, dense):  # the sets of a shingle stand together: each with the one `step` places on
        if len(c) <= step:
            break
        ok = c[step:] == c[:-step]
        i, j = r[:-step][ok], r[step:][ok]
        cross = (i < len(left)) & (j >= len(left))
        np.add.at(out, (i[cross], j[cross] - len(left)), 1)
    return out


def joining_links(nodes: np.ndarray, comps: np.ndarray, n: np.ndarray, sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between sets of side 0 and side 1 (all with all if there is one side) that join different components, no
    more than it takes to join them."""
    a = np.flatnonzero(side == side.min())
    b = np.flatnonzero(side == side.max())
    both = common([sets[i] for i in a], [sets[i] for i in b]).astype(np.int64)
    link = (100 * both >= percent * (n[a][:, None] + n[b][None, :] - both)) & (comps[a][:, None] != comps[b][None, :])
    i, j = np.nonzero(link)
    if not len(i):
        return []
    _, no = np.unique(comps, return_inverse=True)
    lo, hi = np.minimum(no[a[i]], no[b[j]]), np.maximum(no[a[i]], no[b[j]])
    _, one = np.unique(lo * len(nodes) + hi, return_index=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    out = []
    for k in one.tolist():
        x, y = find(int(lo[k])), find(int(hi[k]))
        if x != y:
            root[x] = y
            out.append((int(nodes[a[i[k]]]), int(nodes[b[j[k]]])))
    return out


def block_links(members: DataFrame, sets: DataFrame, percent: int, block: int = 1024) -> DataFrame:
    """members (lead, node, comp), a table: links (a, b) that join components among the sets under one leader."""
    sizes = members.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = salted_join(members, sizes, ["lead"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("lead", "node", "comp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    dealt = materialise(dealt, "jaccard-blocks")
    parts = max(1, dealt.count() // (2 * block))

    def run(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).to_numpy()
        lead, lo, hi = get("lead"), get("lo"), get("hi")
        nodes, comps, n, own = get("node"), get("comp"), get("n").astype(np.int64), get("own")
        toks = table.column("toks").combine_chunks()
        order = np.lexsort((hi, lo, lead))
        same = (np.diff(lead[order]) == 0) & (np.diff(lo[order]) == 0) & (np.diff(hi[order]) == 0)
        out: list[tuple[int, int]] = []
        for g in np.split(order, np.flatnonzero(~same) + 1):
            if lo[g[0]] != hi[g[0]] and len(set(own[g].tolist())) < 2:
                continue
            if len(g) > 1:
                out += joining_links(nodes[g], comps[g], n[g], [np.frombuffer(toks[int(i)].as_buffer(), np.uint64) for i in g], own[g], percent)
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    part = F.pmod(F.xxhash64("lead", "lo", "hi"), F.lit(parts)).alias("part")
    found = dealt.join(sets, "node").select(part, "lead", "node", "comp", "own", "lo", "hi", "n", "toks").groupBy("part").applyInArrow(run, "a long, b long")
    out = materialise(found, "jaccard-links")
    drop(dealt)
    return out


def near_components(docs: DataFrame, k: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", frequent: int = 32, max_filter_bytes: int = 4 << 30, shard_bytes: int = 64 << 20, bucket_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_shingles long, component_id (the least id that links reach, the document's own included)."""
    bits = bucket_bits(docs, text_col, bucket_bytes)
    shards = frequency_filter(docs, k, text_col, bits, frequent, max_filter_bytes, shard_bytes)
    base = materialise(sketch(docs, k, percent, id_col, text_col, bits, shards), "jaccard-sets")
    for sent in shards:
        sent.unpersist()
    can = base.filter(F.col("sigs").isNotNull())
    postings = materialise(can.select("node", "n", F.explode("sigs").alias("sig")).distinct(), "jaccard-postings")
    lists = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("lead"), F.min_by("n", "node").alias("lead_n"))
    lists = materialise(lists.filter("_n > 1"), "jaccard-leads")
    fits = lambda x, y: (100 * F.least(x, y) >= percent * F.greatest(x, y))
    often = hot_keys(postings, ["sig"], lists)
    table = materialise(salted_join(postings, lists.drop("_n"), ["sig"], hot=often), "jaccard-lists")
    sets = salted_join(can, table.select("node").distinct(), ["node"], "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
    sets = materialise(sets, "jaccard-tokens")

    led = table.filter((F.col("node") != F.col("lead")) & fits(F.col("n"), F.col("lead_n")))
    votes = led.groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c"))
    first = materialise(votes.groupBy(F.col("node").alias("b")).agg(F.max_by("lead", F.struct("c", "lead")).alias("a")), "jaccard-pairs")
    links = verify(first, sets, percent, "jaccard-links")
    comp = least_labels(links.toDF("u", "v"))

    own = table.select("sig", "node").join(comp.select(F.col("u").alias("node"), "l"), "node", "left").withColumn("l", F.coalesce("l", "node"))
    mixed = own.groupBy("sig").agg(F.min("l").alias("c0"), F.max("l").alias("c1")).filter("c0 <> c1").select("sig")
    members = salted_join(table.select("sig", "lead", "node"), mixed, ["sig"], "left_semi", hot=often).select("lead", "node").distinct()
    members = materialise(members.join(comp.select(F.col("u").alias("node"), "l"), "node", "left").select("lead", "node", F.coalesce("l", "node").alias("comp")), "jaccard-members")
    more = block_links(members, sets, percent)
    final = least_labels(links.unionByName(more).toDF("u", "v"))

    keyed = salted_join(base.select("doc_id", "n", "node"), final.select(F.col("u").alias("node"), F.col("l").alias("comp")), ["node"], "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("key"))
    keyed = materialise(keyed, "jaccard-keys")
    drop(base, postings, lists, table, sets, first, links, members, more, comp, final)
    least = keyed.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "least")
    out = salted_join(keyed, least, ["key"], "left")
    alone = F.col("key").isNull() | (F.col("least").isNull() & F.col("doc_id").isNotNull())
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """Of rows that links connect the one with the smallest id (null ids last; of equal ids by a hash of the text), with all
    columns. A row is known by its id and text, so an id that stands on several texts says nothing about the others; of
    rows with equal id and text the one whose columns have the least hash stays. Rows that no link reaches are passed on
    where they are."""
    name = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"))
    named = docs.select(F.struct(*docs.columns).alias("whole"), F.monotonically_increasing_id().alias("row"), name.alias("name"), F.col(text_col).alias("t"), row_hash(docs).alias("rank"))
    found = materialise(near_components(named.select("name", "t"), id_col="name", text_col="t", **settings), "jaccard-found")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("name"))
    again = found.groupBy(F.col("doc_id").alias("name")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name")
    touched = marked(materialise(gone.union(again), "jaccard-gone"), ["name"]).may_hold()
    rows = named.filter(ONCE)
    some = rows.filter(touched).groupBy("name").agg(F.min_by("whole", "rank").alias("whole")).join(gone.distinct(), "name", "left_anti")
    return rows.filter(~touched).select("whole.*").unionByName(some.select("whole.*"))


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs)


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN list_aggregate(words, 'string_agg', chr(10)) ELSE list_aggregate(words[i:i + 4], 'string_agg', chr(10)) END AS gram
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r AS (SELECT doc_id AS v, doc_id AS root FROM w UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT v, min(root) AS component_id FROM r GROUP BY v) m ON m.v = w.doc_id
"""
