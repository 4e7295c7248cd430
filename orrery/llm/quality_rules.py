"""Quality rules as a bitmask ledger.

One pass over the texts takes all measurements; one expression turns them into a ledger with a bit for each
rule that a document fails. Policies are versioned sets of rules, that is, masks: applying a policy, or a
different version of it, is a bitwise AND on the stored ledger and never reads a text again. Ablations (what
a policy would reject without one of its rules, and which documents a rule rejects alone) are bitwise
aggregations: documents are counted by masked bits, of which there are at most two to the number of rules.

Defined results: a null text counts as empty (no words, hence too short); texts are measured whole; repeated
rows give repeated rows; an empty table gives an empty result; null ids are carried; measurements are integers, and
rules compare them without division, so nothing depends on rounding. Repeated windows are found by 64-bit hashes within one
text: in a text of a million words the chance that two different windows meet is below 1 in 10 million.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from orrery.llm import text as tx

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_caps_words"]
#: Rules in the order of their bits: (name, condition under which a document fails).
RULES = [
    ("too_short", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("shouting", "100 * n_caps_words > 50 * n_words"),
    ("word_length", "word_chars > 14 * n_words OR word_chars < 2 * n_words"),
]
#: Versions of policies: the names of the rules that each enforces.
POLICIES = {
    "base": ["too_short", "repeated_windows"],
    "v1": ["too_short", "repeated_windows", "symbols", "duplicate_lines", "shouting", "word_length"],
    "v1-no-length": ["too_short", "repeated_windows", "symbols", "duplicate_lines", "shouting"],
}
SYMBOLS = b"#*$%&|<>"
DROP_ALL_BUT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def mask(policy: str) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in POLICIES[policy])


def measure_texts(texts: list[bytes], window: int = 5) -> dict[str, np.ndarray]:
    ids, offsets, vocab = tx.tokenise(texts, lower=False)
    counts = np.diff(offsets)
    decoded = [w.decode("utf-8", "replace") for w in vocab]
    chars = np.array([len(w) for w in decoded], np.int64)
    caps = np.array([w == w.upper() and w != w.lower() for w in decoded], np.int64)
    sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v[ids])])[offsets])
    doc_of = np.repeat(np.arange(len(texts)), counts)
    hashes = tx.hash64(vocab)[ids] if len(ids) else np.zeros(0, np.uint64)
    grams, at = tx.windows(hashes, offsets, window)
    grams = tx.mix(grams ^ tx.mix(doc_of[at].astype(np.uint64), 5))  # a window of one text never equals another's
    order = np.argsort(grams)
    same = np.diff(grams[order]) == 0
    twice = np.zeros(len(grams), bool)
    twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(grams) else False
    edges = np.zeros(len(ids) + 1, np.int64)
    starts = at[twice]
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    covered = (np.cumsum(edges)[:-1] > 0).astype(np.int64)
    lines, dup = [], []
    for t in texts:
        own = [x for x in t.split(b"\n") if x and not x.isspace()]
        lines.append(len(own))
        dup.append(len(own) - len(set(own)))
    return {
        "n_words": counts,
        "word_chars": sums(chars) if len(ids) else np.zeros(len(texts), np.int64),
        "n_symbols": np.array([len(t.translate(None, DROP_ALL_BUT_SYMBOLS)) for t in texts], np.int64),
        "n_lines": np.array(lines, np.int64),
        "n_dup_lines": np.array(dup, np.int64),
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(covered)])[offsets]),
        "n_caps_words": sums(caps) if len(ids) else np.zeros(len(texts), np.int64),
    }


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with every measurement and failed_bits long, one row per input row.
    Columns of the input that are named like a measurement give way to it."""
    names = [c for c in (keep if keep is not None else docs.columns) if c not in (*MEASURES, "failed_bits")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in tx.chunks(batches, text_col):
            got = measure_texts(tx.raw(rb.column(text_col)))
            yield tx.with_columns(rb, names, **{k: pa.array(got[k], pa.int64()) for k in MEASURES})

    read = docs.select(*dict.fromkeys([*names, text_col]))
    measured = read.mapInArrow(run, tx.schema_of(read, names, **dict.fromkeys(MEASURES, LongType())))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long") for i, (_, rule) in enumerate(RULES)]
    return measured.withColumn("failed_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def apply_policy(kept_ledger: DataFrame, policy: str) -> DataFrame:
    """Adds policy_bits (failed rules that the policy enforces) and kept."""
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(policy)))
    return kept_ledger.withColumns({"policy_bits": bits, "kept": bits == 0})


def ablations(kept_ledger: DataFrame, policy: str) -> DataFrame:
    """For each rule of the policy: rule, n_failed, n_only (rejected by it alone), n_rejected_without, n_rejected, n_documents."""
    all_bits = mask(policy)
    by_bits = kept_ledger.groupBy(F.col("failed_bits").bitwiseAND(F.lit(all_bits)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [name for name, _ in RULES]
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << names.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]])
    fits = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    pairs = by_bits.select("bits", "n", F.inline(rules))  # at most 2 ** rules rows, each once for every rule
    rest = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    return pairs.groupBy("rule").agg(
        fits(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        fits(F.col("bits") == F.col("bit")).alias("n_only"),
        fits(rest != 0).alias("n_rejected_without"),
        fits(F.col("bits") != 0).alias("n_rejected"),
        F.sum("n").alias("n_documents"),
    )


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = apply_policy(ledger(docs, keep=["doc_id"]), "v1")
    base = F.col("failed_bits").bitwiseAND(F.lit(mask("base"))) != 0
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (F.col("kept") & ~base).alias("kept"), "failed_bits")


OP9_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', chr(10)) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM r, (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda x: x = upper(x) AND x <> lower(x)))::BIGINT AS n_caps_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (
  SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_caps_words > 50 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 14 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed_bits & 3 <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""


def quality_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 rejects, alone and beside the others, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ablations(ledger(docs, keep=["doc_id"]), "v1")


ABLATIONS_SQL = (
    OP9_SQL.rsplit("SELECT doc_id, n_words", 1)[0].rstrip()
    + """,
r6(rule, bit) AS (VALUES ('too_short', 1), ('repeated_windows', 2), ('symbols', 4), ('duplicate_lines', 8), ('shouting', 16), ('word_length', 32))
SELECT rule, count(*) FILTER (failed_bits & bit <> 0) AS n_failed, count(*) FILTER (failed_bits = bit) AS n_only,
  count(*) FILTER (failed_bits & ~bit <> 0) AS n_rejected_without, count(*) FILTER (failed_bits <> 0) AS n_rejected, count(*) AS n_documents
FROM b, r6 GROUP BY rule
"""
)
