"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

Training counts hashed byte n-grams of words by language, on a sample of labelled documents (at most per_lang
for each language, chosen by a hash of the id, and about max_bytes of text in all), and which scripts each language is
written in. A token is a word, or a run of letters of one script where a word holds several, so text without spaces is
cut where its script changes. Only languages that use a token's script are candidates, and of each candidate it gets a
score: the scaled log probability of its n-grams, within `clip` of the best candidate's. The best path through
the tokens of a text, where a change of language costs `penalty`, labels spans; tokens without a letter take
the label that the path gives them. A document's language is the one whose spans hold most letters.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the language first in
the alphabet; texts are labelled whole; without labelled documents everything is `und`; rows with a null id are
labelled like others, but not learned from; repeated rows give repeated rows; an empty table gives an empty result;
columns other than id and text are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm import text as tx

SIZES = (1, 2, 3, 4)
EDGES = b"\"'`.,;:!?()[]{}<>*#%&$|/\\-_+=~^@0123456789"
#: First code points of script ranges, with the script that begins there.
SCRIPTS = [
    (0x0, "none"), (0x41, "latin"), (0x250, "latin"), (0x2B0, "none"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"),
    (0x590, "hebrew"), (0x600, "arabic"), (0x700, "other"), (0x900, "devanagari"), (0x980, "bengali"), (0xA00, "gurmukhi"),
    (0xA80, "gujarati"), (0xB00, "other"), (0xB80, "tamil"), (0xC00, "telugu"), (0xC80, "kannada"), (0xD00, "malayalam"),
    (0xD80, "sinhala"), (0xE00, "thai"), (0xE80, "lao"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"),
    (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
STARTS = np.array([s for s, _ in SCRIPTS])
NAMES = sorted({n for _, n in SCRIPTS})
SCRIPT_NO = np.array([NAMES.index(n) for _, n in SCRIPTS])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # 2 ** bits by languages, log probabilities
    uses: np.ndarray  # scripts by languages
    clip: float = 8.0
    scale: float = 0.5
    penalty: float = 6.0


def normal(words: list[bytes]) -> list[str]:
    return [w.strip(EDGES).decode("utf-8", "replace").lower() for w in words]


def scripts(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Script number by the first letter, and the number of letters (0 letters: script of no meaning)."""
    letters = np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words], np.int64)
    first = np.array([0 if not n else ord(w[0]) if w[0].isalpha() else ord(next(c for c in w if c.isalpha())) for w, n in zip(words, letters, strict=True)], np.int64)
    return SCRIPT_NO[np.searchsorted(STARTS, first, side="right") - 1], letters


def script_of(code: int) -> int:
    return NAMES.index(SCRIPTS[bisect_right(SCRIPTS, (code, "~")) - 1][1])


def may_change(words: list[str]) -> np.ndarray:
    """False only for words whose characters are all of one script, but for those that every script has."""
    lens = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "replace"), "<u4")
    script = SCRIPT_NO[np.searchsorted(STARTS, codes, side="right") - 1]
    none, starts = NAMES.index("none"), np.concatenate([[0], np.cumsum(lens)])[:-1]
    most = np.maximum.reduceat(np.where(script == none, -1, script), starts)
    least = np.minimum.reduceat(np.where(script == none, len(NAMES), script), starts)
    return least < most


def script_runs(word: bytes) -> list[bytes]:
    """The word, cut before each letter whose script is not that of the letter before it."""
    out, script = [""], None
    for c in word.decode("utf-8", "replace"):
        own = script_of(ord(c)) if c.isalpha() else script
        if script is not None and own != script:
            out.append("")
        script = own
        out[-1] += c
    return [x.encode("utf-8", "replace") for x in out]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Token numbers of all texts in a row, offsets of each text, and the distinct tokens."""
    ids, offsets, vocab = tx.tokenise(texts, lower=False)
    wide = [i for i, w in enumerate(vocab) if not w.isascii()]
    some = may_change([vocab[i].decode("utf-8", "replace") for i in wide]) if wide else []
    runs = {i: r for i, ok in zip(wide, some, strict=True) if ok and len(r := script_runs(vocab[i])) > 1}
    if not runs:
        return ids, offsets, vocab
    known = tx.Vocab((w, i) for i, w in enumerate(vocab))
    flat = [x for i in range(len(vocab)) for x in ([known[r] for r in runs[i]] if i in runs else [i])]
    size = np.ones(len(vocab), np.int64)
    size[list(runs)] = [len(r) for r in runs.values()]
    starts, n = np.concatenate([[0], np.cumsum(size)])[:-1], size[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    places = np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], n)
    return np.array(flat, np.int32)[places], ends[offsets], list(known)


def ngrams(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words in a row, with the number of the word of each."""
    coded = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    lens = np.array([len(c) for c in coded], np.int64)
    ends = np.cumsum(lens)
    flat = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lens)
    room = np.repeat(ends, lens) - np.arange(len(flat))  # bytes from here to the word's end
    out, who = [], []
    for n in SIZES:
        if len(flat) < n:
            continue
        h = np.zeros(len(flat) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(257) + flat[j : len(flat) - n + 1 + j]
        at = np.flatnonzero(room[: len(h)] >= n)
        out.append((tx.mix(h[at], n) >> np.uint64(64 - bits)).astype(np.int64))
        who.append(owner[at])
    whole = tx.hash64(coded)
    out.append((tx.mix(whole, 9) >> np.uint64(64 - bits)).astype(np.int64))
    who.append(np.arange(len(words)))
    return np.concatenate(out), np.concatenate(who)


def train(rows: list[tuple[str, bytes]], bits: int = 18, least_use: float = 1e-3) -> Model:
    langs = sorted({lang for lang, _ in rows})
    counts = np.zeros((1 << bits, len(langs)), np.float32)
    used = np.zeros((len(NAMES), len(langs)))
    for k, lang in enumerate(langs):
        ids, _, vocab = tokens([t for own, t in rows if own == lang])
        if not len(ids):
            continue
        times = np.bincount(ids, minlength=len(vocab))
        words = normal(vocab)
        script, letters = scripts(words)
        used[:, k] = np.bincount(script, times * letters, minlength=len(NAMES))
        hashes, who = ngrams(words, bits)
        counts[:, k] = np.bincount(hashes, np.sqrt(times)[who] * (letters > 0)[who], minlength=1 << bits)
    total = counts.sum(axis=0)
    table = np.log((counts + 0.2) / (total + 0.2 * (counts.sum(axis=1) > 0).sum() + 1)).astype(np.float32)
    return Model(langs, table, used / np.maximum(1, used.sum(axis=0)) >= least_use)


def word_scores(vocab: list[bytes], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Scores (words by languages, the best is 0; all 0 for words without a letter) and numbers of letters."""
    words = normal(vocab)
    script, letters = scripts(words)
    bits = int(len(m.table)).bit_length() - 1
    hashes, who = ngrams(words, bits)
    order = np.argsort(who, kind="stable")
    cuts = np.searchsorted(who[order], np.arange(len(words)))
    score = np.add.reduceat(m.table[hashes[order]], cuts, axis=0) * np.float32(m.scale)
    uses = m.uses[script]
    uses[~uses.any(axis=1)] = True  # a script that no language uses narrows nothing
    score = np.where(uses, score, -np.inf)
    score = np.maximum(score - score.max(axis=1, keepdims=True), -np.float32(m.clip))
    score = np.where(uses, score, -2 * np.float32(m.clip))
    score[letters == 0] = 0
    return score.astype(np.float32), letters


def viterbi(emit: np.ndarray, ids: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each token; texts advance side by side, the longest first, so that those still running are a prefix."""
    lens = np.diff(offsets)
    order = np.argsort(-lens, kind="stable")
    starts, sorted_lens = offsets[:-1][order], lens[order]
    running = np.searchsorted(-sorted_lens, -np.arange(1, int(lens.max(initial=0)) + 1), side="right")
    number = np.int16 if emit.shape[1] < 1 << 15 else np.int32  # of a language
    best_before = np.zeros(len(ids), number)  # where the path comes from if it changes here
    stays = np.zeros((len(ids), emit.shape[1]), bool)
    value = np.zeros((len(lens), emit.shape[1]), np.float32)
    for t, n in enumerate(running):
        at = starts[:n] + t
        if t:
            v = value[:n]
            top = v.argmax(axis=1)
            change = v[np.arange(n), top][:, None] - np.float32(penalty)
            keep = v >= change
            stays[at], best_before[at] = keep, top
            value[:n] = np.where(keep, v, change) + emit[ids[at]]
        else:
            value[:n] = emit[ids[at]]
    out = np.zeros(len(ids), number)
    last = value.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        at = starts[:n] + t
        own = last[:n]
        out[at] = own
        if t:
            last[:n] = np.where(stays[at, own], own, best_before[at])
    return out


def label_texts(texts: list[bytes], m: Model) -> tuple[list[str], np.ndarray, list[list[tuple[str, int, int]]]]:
    """Each text's language, its score, and its spans (language, first token, number of tokens)."""
    ids, offsets, vocab = tokens(texts)
    n, k = len(texts), len(m.langs)
    if not k or not len(ids):
        return ["und"] * n, np.zeros(n), [[] for _ in texts]
    emit, letters = word_scores(vocab, m)
    path = viterbi(emit, ids, offsets, m.penalty)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    held = np.bincount(doc * k + path, letters[ids], minlength=n * k).reshape(n, k)
    best = held.argmax(axis=1)
    total = held.sum(axis=1)
    # Evidence: how far the language is ahead of the next one over the document's words.
    sums = np.stack([np.bincount(doc, emit[ids, j], minlength=n) for j in range(k)], axis=1)
    own = sums[np.arange(n), best]
    sums[np.arange(n), best] = -np.inf
    ahead = np.clip(own - (sums.max(axis=1) if k > 1 else own - 30), -30, 30)
    score = np.where(total > 0, held[np.arange(n), best] / np.maximum(total, 1) / (1 + np.exp(-ahead)), 0.0)
    spans = []
    for i in range(n):
        p = path[offsets[i] : offsets[i + 1]]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(p)) + 1, [len(p)]]) if len(p) and total[i] else np.zeros(1, np.int64)
        spans.append([(m.langs[p[a]], int(a), int(z - a)) for a, z in zip(cut[:-1], cut[1:], strict=True)])
    return [m.langs[b] if t else "und" for b, t in zip(best, total, strict=True)], score, spans


def fit(train_docs: DataFrame, per_lang: int = 500, max_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from at most per_lang documents of each language; beyond its even part of max_bytes a language's sample takes
    no further document."""
    known = train_docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"))
    hashed = known.select("lang", F.xxhash64("i").alias("h"), "i")
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("i").alias("c"))  # a row a language
    n_langs = max(1, sizes.count())
    # About three times as many as wanted, by another hash of the id, then the first of those: no language meets in one task.
    some = hashed.join(F.broadcast(sizes), "lang").filter(F.pmod(F.xxhash64(F.lit(3), "i"), F.lit(1 << 20)) * F.col("c") < 3 * per_lang * (1 << 20))
    first = lambda df, *by: df.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("n") <= per_lang)
    ids = F.broadcast(first(some, "h", "i").select("i").distinct())
    rows = first(known.join(ids, "i", "left_semi").withColumns({"h": F.xxhash64("i"), "th": F.xxhash64("t")}), "h", "i", "th")  # an id may stand on several rows
    before = F.coalesce(F.sum(F.octet_length("t")).over(Window.partitionBy("lang").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).filter(F.col("before") < max_bytes // n_langs).select("h", "i", "th", "lang", "t")
    found = sorted((r["h"], str(r["i"]), r["th"], r["lang"], (r["t"] or "").encode()) for r in rows.collect())
    return train([r[3:] for r in found])


def identify(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, lang_score and, if asked for, spans array<struct<lang, first_token, n_tokens>>."""
    sent = docs.sparkSession.sparkContext.broadcast(m)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("first_token", pa.int32()), ("n_tokens", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tx.chunks(batches, text_col, (4 << 20) * 16 // max(16, len(sent.value.langs))):
            langs, score, found = label_texts(tx.raw(rb.column(text_col)), sent.value)
            cols = [rb.column(id_col), pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array([[dict(zip(("lang", "first_token", "n_tokens"), s, strict=True)) for s in x] for x in found], kind))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "lang_score", *["spans"] * spans])

    read = docs.select(id_col, text_col)
    schema = f"doc_id {read.schema[id_col].dataType.simpleString()}, lang_pred string, lang_score double"
    return read.mapInArrow(run, schema + ", spans array<struct<lang: string, first_token: int, n_tokens: int>>" * spans)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = tx.crc_mod("doc_id", 4) == 2
    m = fit(docs.filter(~held_out))
    return identify(docs, m, spans=False).select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
