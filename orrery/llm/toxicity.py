"""Convolutional text classifier for toxicity: hashed word embeddings, filters of several widths, max pooling.

A word's vector is the sum of embeddings of hashed features: the word itself and its first letters (so that
inflections share what they learn). Filters of widths 1 to 3 slide over the whole text, each keeps its
largest value, and a logistic unit weighs them. Training is mini-batch Adam in numpy on the driver, on a
sample of labelled documents whose size in rows and bytes is a parameter; only features seen there have embeddings, so what is
broadcast is bounded by the sample. Features are hashed to 64 bits; one never seen counts as the zero vector.

Thresholds are calibrated by language on held-back training documents. The language is guessed from the text
alone (counts of function words); each language's threshold is moved to a score of 0.5.

Defined results: null and empty texts are scored like a text of no words; texts are scored whole, in pieces
of memory that don't grow with the table; a document with several labels counts as toxic if one says so,
labels that are null are skipped, and so are null ids in learning; of an id with several texts the least is learned from; without labels of both kinds every score is 0; repeated rows give
repeated rows; an empty table gives an empty result; the input's other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orrery.llm import text as tx

DIM, FILTERS, WIDTHS, PREFIXES = 12, 16, (1, 2, 3), (4, 5, 6)
#: Function words by which the calibration language of a text is guessed.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht ein eine zu von mit den dem des auf für im auch sich",
    "en": "the and of to in is was that for it with as on are by this be at from or",
    "es": "el los las y que un una por con para del se su como más al lo es no",
    "fr": "le les et des une est dans pour que qui du au pas sur par en il elle de la",
}
EDGES = b"\"'`.,;:!?()[]{}<>*#%&$|/\\-_+=~^@"


def word_features(words: list[bytes]) -> np.ndarray:
    """Hashes (n words by features; 0 stands for none) of the word without marks at its edges, and of its beginnings."""
    bare = [w.strip(EDGES).decode("utf-8", "replace").lower() for w in words]
    out = np.zeros((len(words), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = tx.hash64([b"w" + w.encode("utf-8", "replace") for w in bare])
    for j, p in enumerate(PREFIXES, 1):
        h = tx.hash64([b"p" + w[:p].encode("utf-8", "replace") for w in bare])
        out[:, j] = np.where([len(w) >= p for w in bare], h, 0)
    out[[not w for w in bare]] = 0
    return out


def guess_language(ids: np.ndarray, offsets: np.ndarray, vocab: list[bytes]) -> np.ndarray:
    """Number of the language with the most function words (in the order of FUNCTION_WORDS), or -1 without any."""
    n = len(offsets) - 1
    counts = np.zeros((n, len(FUNCTION_WORDS)))
    bare = [w.strip(EDGES) for w in vocab]
    for k, words in enumerate(FUNCTION_WORDS.values()):
        known = {w.encode() for w in words.split()}
        flag = np.array([w in known for w in bare], np.int64)
        if len(ids):
            counts[:, k] = np.diff(np.concatenate([[0], np.cumsum(flag[ids])])[offsets])
    return np.where(counts.max(axis=1, initial=0) > 0, counts.argmax(axis=1), -1)


class Net:
    """keys: sorted feature hashes, table: their embeddings (row 0: none), w: filters by width and place, b, v, c."""

    def __init__(self, keys: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.keys = keys
        self.table = (rng.standard_normal((len(keys) + 1, DIM)) * 0.01).astype(np.float32)
        self.table[0] = 0
        self.w = {k: (rng.standard_normal((k, DIM, FILTERS)) * 0.3).astype(np.float32) for k in WIDTHS}
        self.b = {k: np.zeros(FILTERS, np.float32) for k in WIDTHS}
        self.v = (np.abs(rng.standard_normal(FILTERS * len(WIDTHS))) * np.where(np.arange(FILTERS * len(WIDTHS)) % 4 == 0, -1, 1) * 0.3).astype(np.float32)
        self.c = np.float32(-1.0)
        self.shift = np.zeros(len(FUNCTION_WORDS) + 1, np.float32)  # the last one is for no language

    def rows(self, features: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(features.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where((self.keys[at] == features) & (features != 0), at + 1, 0)

    def pooled(self, x: np.ndarray, ids: np.ndarray, offsets: np.ndarray, need_places: bool = False):
        """x: vectors of distinct words, the last one zero; ids: padded by such words after each text. A filter may start
        at the first of them, so that every text has a place, and then reads no word of the next text."""
        starts, best, places = offsets[:-1], [], []
        shut = np.concatenate([offsets[1:] - i for i in range(1, max(WIDTHS))])
        for k in WIDTHS:
            part = np.zeros((len(ids), FILTERS), x.dtype)
            for j in range(k):
                part[: len(ids) - j] += (x @ self.w[k][j])[ids[j:]]
            part += self.b[k]
            part[shut] = -np.inf
            best.append(np.maximum.reduceat(part, starts, axis=0))
            if need_places:
                places.append(np.stack([part[a:z].argmax(axis=0) + a for a, z in zip(starts, offsets[1:], strict=True)]))
        return np.concatenate(best, axis=1), places

    def logits(self, ids: np.ndarray, offsets: np.ndarray, vocab: list[bytes]) -> np.ndarray:
        x = self.table[self.rows(word_features(vocab))].sum(axis=1) if vocab else np.zeros((0, DIM), np.float32)
        ids, offsets = padded(ids, offsets, len(vocab))
        h, _ = self.pooled(np.vstack([x, np.zeros((1, DIM), np.float32)]), ids, offsets)
        return np.maximum(h, 0) @ self.v + self.c


def padded(ids: np.ndarray, offsets: np.ndarray, pad: int, by: int = max(WIDTHS)) -> tuple[np.ndarray, np.ndarray]:
    n = len(offsets) - 1
    new = offsets + by * np.arange(n + 1)
    out = np.full(int(new[-1]), pad, np.int32)
    out[np.arange(len(ids)) + by * np.repeat(np.arange(n), np.diff(offsets))] = ids
    return out, new


def with_snippets(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> tuple[list[bytes], np.ndarray]:
    """Adds short stretches of the clean texts, and empty texts, as clean: a text is not toxic for being short."""
    rng = np.random.default_rng(seed)
    more = [b""] * max(1, len(texts) // 100)
    for t, y in zip(texts, labels, strict=True):
        words = t.split()
        if y == 0 and words:
            at, n = int(rng.integers(len(words))), int(rng.integers(1, 13))
            more.append(b" ".join(words[at : at + n]))
    return [*texts, *more], np.concatenate([labels, np.zeros(len(more), labels.dtype)])


def gradients(net: Net, x: np.ndarray, ids: np.ndarray, offsets: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """The weighted log loss of padded texts (a mean), its gradients by parameter, and by word vector."""
    h, places = net.pooled(x, ids, offsets, need_places=True)
    z = np.maximum(h, 0) @ net.v + net.c
    loss = float((weight * (np.logaddexp(0, z) - labels * z)).sum() / len(labels))
    d = ((1 / (1 + np.exp(-z)) - labels) * weight / len(labels)).astype(x.dtype)
    grad = {"v": np.maximum(h, 0).T @ d, "c": d.sum()}
    dh = d[:, None] * net.v * (h > 0)
    dx = np.zeros_like(x)
    for n, k in enumerate(WIDTHS):
        g = dh[:, n * FILTERS : (n + 1) * FILTERS]
        grad[f"w{k}"], grad[f"b{k}"] = np.zeros_like(net.w[k]), g.sum(axis=0)
        for j in range(k):
            at = ids[np.minimum(places[n] + j, len(ids) - 1)]  # texts by filters
            grad[f"w{k}"][j] = np.einsum("df,dfe->ef", g, x[at])
            np.add.at(dx, at.ravel(), (g[:, :, None] * net.w[k][j].T[None]).reshape(-1, x.shape[1]))
    return loss, grad, dx


def train(texts: list[bytes], labels: np.ndarray, visits: int = 40_000, batch: int = 16, rate: float = 0.02, l2: float = 2e-5, seed: int = 11) -> Net:
    texts, labels = with_snippets(texts, labels, seed)
    ids, offsets, vocab = tx.tokenise(texts)
    features = word_features(vocab)
    keys, seen = np.unique(features[features != 0], return_counts=True)
    net = Net(keys, seed)
    rows = np.vstack([net.rows(features), np.zeros((1, features.shape[1]), np.int64)])
    rng = np.random.default_rng(seed)
    weight = np.where(labels == 1, min(4.0, (labels == 0).sum() / max(1, (labels == 1).sum())), 1.0)
    state: dict[str, list[np.ndarray]] = {}
    moment = np.zeros((len(net.table), 1), np.float32)
    step = 0

    def adam(name: str, value: np.ndarray, grad: np.ndarray) -> np.ndarray:
        m, s = state.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m += 0.1 * (grad - m)
        s += 0.01 * (grad**2 - s)
        return value - 0.2 * rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)

    for _ in range(int(np.clip(visits // max(1, len(texts)), 6, 16))):
        for group in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
            step += 1
            own = [ids[offsets[i] : offsets[i + 1]] for i in group]
            words, flat = np.unique(np.concatenate([*own, [len(vocab)]]), return_inverse=True)
            x = net.table[rows[words]].sum(axis=1)
            local, at = padded(flat[:-1].astype(np.int32), np.concatenate([[0], np.cumsum([len(o) for o in own])]), len(words) - 1)
            _, grad, dx = gradients(net, x, local, at, labels[group], weight[group])
            for k in WIDTHS:
                net.w[k] = adam(f"w{k}", net.w[k], grad[f"w{k}"] + l2 * net.w[k])
                net.b[k] = adam(f"b{k}", net.b[k], grad[f"b{k}"])
            net.v, net.c = adam("v", net.v, grad["v"] + l2 * net.v), net.c - np.float32(rate * grad["c"])
            dx[-1] = 0
            hit = np.flatnonzero(np.abs(dx).sum(axis=1) > 0)
            entry = rows[words[hit]]
            flat_rows, flat_grad = entry.ravel(), np.repeat(dx[hit], entry.shape[1], axis=0)
            uniq, inv = np.unique(flat_rows, return_inverse=True)
            grad = np.zeros((len(uniq), DIM), np.float32)
            np.add.at(grad, inv, flat_grad)
            moment[uniq] += (grad**2).mean(axis=1, keepdims=True)
            net.table[uniq] -= 5 * rate * grad / (np.sqrt(moment[uniq]) + 1e-5)
            net.table[0] = 0
    return net


def calibrate(net: Net, texts: list[bytes], labels: np.ndarray, least: int = 10) -> None:
    """Sets each language's threshold where F1 on these texts is best, in the middle of that stretch; a language with
    fewer than `least` texts of a kind takes the threshold of all."""
    texts, labels = with_snippets(texts, labels, 6)
    ids, offsets, vocab = tx.tokenise(texts)
    z, lang = net.logits(ids, offsets, vocab), guess_language(ids, offsets, vocab)

    def best(z: np.ndarray, y: np.ndarray) -> float:
        cuts = np.unique(z)
        mids = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
        f1 = np.array([2 * ((z > t) & (y == 1)).sum() / max(1, (z > t).sum() + (y == 1).sum()) for t in mids])
        top = np.flatnonzero(f1 == f1.max())
        return float((mids[top[0]] + mids[top[-1]]) / 2)

    enough = lambda y: (y == 1).sum() >= least and (y == 0).sum() >= least
    net.shift[:] = best(z, labels) if (labels == 1).any() and (labels == 0).any() else 0
    for k in range(len(net.shift) - 1):
        own = lang == k
        if enough(labels[own]):
            net.shift[k] = best(z[own], labels[own])
    none = net.logits(np.zeros(0, np.int32), np.zeros(2, np.int64), [])[0]
    net.shift[:] = np.maximum(net.shift, none + 0.5)  # a text without evidence stays below the threshold


def score_texts(net: Net, texts: list[bytes]) -> np.ndarray:
    ids, offsets, vocab = tx.tokenise(texts)
    z = net.logits(ids, offsets, vocab) - net.shift[guess_language(ids, offsets, vocab)]
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_class: int = 2000, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[bytes, int]]:
    """At most per_class documents of either label, chosen by a hash of the id among rows that may be learned from; beyond
    half of max_bytes of text a label takes no further document. Of an id with several texts the least one counts."""
    one = labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_y"))
    order = [F.xxhash64("_id"), F.col("_id")]
    picked = reduce(DataFrame.unionByName, [one.filter(F.col("_y") == y).orderBy(*order).limit(per_class) for y in (0, 1)])
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(picked), "_id").groupBy("_id", "_y").agg(F.min("_t").alias("_t"))
    before = F.sum(F.octet_length("_t")).over(Window.partitionBy("_y").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = found.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < max_bytes // 2)
    return sorted(((r["_id"], (r["_t"] or "").encode(), int(r["_y"])) for r in rows.collect()), key=lambda r: r[0])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, **names) -> Net | None:
    """None without labels of both kinds. Every fifth document of the sample is held back for the thresholds."""
    rows = labelled_sample(docs, labels, per_class=per_class, **names)
    y = np.array([r[2] for r in rows])
    if not ((y == 0).any() and (y == 1).any()):
        return None
    texts = [r[1] for r in rows]
    back = np.zeros(len(y), bool)
    for kind in (0, 1):
        back[np.flatnonzero(y == kind)[2::5]] = True
    pick = lambda m: ([t for t, ok in zip(texts, m, strict=True) if ok], y[m])
    net = train(*pick(~back))
    calibrate(net, *(pick(back) if (y[back] == 1).any() and (y[back] == 0).any() else pick(~back)))
    used = np.flatnonzero(np.abs(net.table[1:]).max(axis=1) > 0)
    net.keys, net.table = net.keys[used], np.vstack([net.table[:1], net.table[1:][used]])
    return net


def score(docs: DataFrame, net: Net | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with toxic_score double."""
    names = [c for c in (keep if keep is not None else docs.columns) if c != "toxic_score"]
    if net is None:
        return docs.select(*names, F.lit(0.0).alias("toxic_score"))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tx.chunks(batches, text_col, 2 << 20):
            yield tx.with_columns(rb, names, toxic_score=pa.array(score_texts(sent.value, tx.raw(rb.column(text_col))), pa.float64()))

    read = docs.select(*dict.fromkeys([*names, text_col]))
    return read.mapInArrow(run, tx.schema_of(read, names, toxic_score=DoubleType()))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    net = fit(docs, labels.filter(tx.crc_mod("doc_id", 5) != 0))
    scored = score(docs, net, keep=["doc_id"])
    return scored.select("doc_id", (tx.crc_mod("doc_id", 5) == 0).alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))
