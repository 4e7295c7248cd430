"""Packing, LM scoring, language identification, toxicity, Jaccard join, pipeline."""

import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from orrery.llm import jaccard_join, language_id, lm_score, packing, quality_rules, toxicity
from orrery.llm import text as tx


def rows(df):
    return [r.asDict() for r in df.collect()]


# op1


def brute_pack(lens, t, d, a, rule, w, tile=1):
    bins = []
    for n in sorted(lens, reverse=True):
        need, best = (n, 1, (-(-n // tile)) ** 2), None
        for i, free in enumerate(bins):
            if all(f >= x for f, x in zip(free, need, strict=True)):
                if rule == "dot":
                    s = -sum(x * (f / c) * (q / c) for x, f, q, c in zip(w, free, need, (t, d, a), strict=True))
                else:
                    s = sum(x * ((f - q) / c) ** 2 for x, f, q, c in zip(w, free, need, (t, d, a), strict=True))
                if best is None or s < best[0]:
                    best = (s, i)
        if best is None:
            bins.append([t, d, a])
            best = (0, len(bins) - 1)
        bins[best[1]] = [f - q for f, q in zip(bins[best[1]], need, strict=True)]
    return len(bins)


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan(rule):
    rng = random.Random(3)
    for _ in range(40):
        t = rng.choice([20, 50, 64])
        tile = rng.choice([1, 4, 9])
        full = (-(-t // tile)) ** 2
        d, a = rng.choice([2, 4, t]), rng.choice([full, full + 3, -(-full // 2)])
        lens = [rng.randint(1, min(t, int(a**0.5) * tile)) for _ in range(rng.randint(1, 200))]
        steps, n = packing.plan(Counter(lens), t, d, a, rule, tile=tile)
        assert n == brute_pack(lens, t, d, a, rule, (1.0, 0.01, 0.01), tile)
        bins = {}
        for length, lo, hi, first, each, offset in steps:
            for r in range(hi - lo):
                bins.setdefault(first + r // each, []).append((offset + r % each * length, length))
        assert Counter(x for b in bins.values() for _, x in b) == Counter(lens)
        for b in bins.values():
            at = 0
            for o, length in sorted(b):
                assert o == at
                at += length
            assert at <= t and len(b) <= d and sum((-(-x // tile)) ** 2 for _, x in b) <= a
    with pytest.raises(ValueError):
        packing.plan({100: 1}, 50, 5, 2500)


def test_every_capacity_binds():
    """With the values of pack, tokens, documents and attention cost each decide somewhere how many sequences there are."""
    count = lambda lens, **more: packing.plan(Counter(lens), **{"max_tokens": 2048, "max_docs": packing.MAX_DOCS, "max_cost": packing.MAX_COST, "tile": packing.TILE, **more})[1]
    long, tiny, edge = [1500] * 10, [3] * 640, [129] * 60 + [1] * 700
    assert count(long) == 10 and count(long, max_docs=10**6, max_cost=10**9) == 10 > -(-sum(long) // 2048)
    assert count(tiny) == 10 and count(tiny, max_docs=10**6) < 10  # documents
    assert packing.MAX_COST >= (2048 / packing.TILE) ** 2  # a piece of 2048 tokens fits
    full = [2045] * 20 + [1] * 60
    assert count(full, max_cost=10**9) == 20 and count(full, max_cost=257) > 20
    assert count([1921] * 20 + [1] * 127 * 20, max_docs=10**6) > count([1921] * 20 + [1] * 127 * 20, max_docs=10**6, max_cost=10**9) == 20  # attention
    assert count(edge) >= -(-sum(edge) // 2048)


def test_packing_many_of_one_length(spark, make_docs):
    """Groups by each length's count: ranks are gapless, repeated and null ids too."""
    data = [(None if i % 5 == 0 else i % 7, "word " * (1 + i % 3)) for i in range(400)]
    got = rows(packing.pack(packing.split_pieces(make_docs(data), packing.byte_bpe), rows_per_salt=20))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 400 and Counter(r["doc_id"] for r in got) == Counter(i for i, _ in data)
    assert sorted(bins) == list(range(len(bins)))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048 and len(b) <= packing.MAX_DOCS


def test_packing_ids_are_those_of_tokenizers(languages):
    """The rank file in tiktoken's core gives the ids of the tokenizers file, on every document and on odd Unicode."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    tok, rng = Tokenizer.from_file(P.path("byte_bpe_50k.json")), random.Random(4)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x3000), rng.randrange(0x3000, 0xD800), rng.randrange(0xE000, 0x30000), 0x200D, 0x85, 0x0B, 0x2028, 0xFEFF])) for _ in range(rng.randrange(1, 60))) for _ in range(2000)]
    odd += ["I'LL we'Re don't it'S", "a\r\n\r\n  b\u3000\u00a0 c", "\u0130\u0131 ſ K", "١٢٣ ²³ ½ Ⅷ", "e\u0301 \u0301", " \t\n x ", "👩‍👩‍👧‍👦 🏳️‍🌈", "\x00\x1f\x7f\x80"]
    texts = [t for _, t, _ in languages if t] + odd
    got = packing.byte_bpe()(texts)
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_packing_whole(make_docs, odd_rows, prose):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    data = odd_rows + [(100 + i, prose(i, 37 * i + 1)) for i in range(40)]
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = rows(packing.pack(packing.split_pieces(make_docs(data), packing.byte_bpe)))
    want = Counter()
    for i, t in data:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % 2048 or 2048
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    assert packing.pack(packing.split_pieces(make_docs([]), packing.byte_bpe)).count() == 0


# op3


def lm_words(t):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(tx.LOWER)), None]


def lm_counts(texts):
    """Counts of words, pairs and triples; the start is the empty word."""
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        w = [b"", *lm_words(t)]
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
        three.update(zip(w, w[1:], w[2:], strict=False))
    return one, two, three


def floor_of_level(n):
    """A count as the filter gives it back: 1, or the last of 2, 3, 4, 6, 10, ... that it reaches."""
    out = n if n < 2 else 2
    level = 0
    while n >= 2 and 2 * 1.5 ** (level + 1) <= n + 1e-9:
        level += 1
        out = math.floor(2 * 1.5**level + 1e-9)
    return out


def test_bucket_sums_take_little_memory():
    """Sums of 32-bit keys against numpy's, and the filter against one made at once, in little more room than the keys."""
    rng = np.random.default_rng(5)
    once, more = (rng.integers(0, 1 << 22, n).astype(np.uint32) for n in (400_000, 100_000))
    n = rng.integers(2, 1 << 16, len(more)).astype(np.uint32)
    keys, at = np.unique(np.concatenate([once, more]), return_inverse=True)
    want = np.bincount(at, np.concatenate([np.ones(len(once)), n])).astype(np.int64)
    m = lm_score.Model(12)
    tracemalloc.start()
    got, counts = lm_score.sums_of_short(once, more, n)
    bits = lm_score.segment(got, counts, lm_score.PAIRS, m)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == keys).all() and (counts == want).all()
    assert (bits == lm_score.segment(got, counts, lm_score.PAIRS, m, block=1 << 30)).all()
    assert peak < 50 * (len(once) + len(more))
    words = lm_score.sums_of_words(*(np.array(v, t) for v, t in (([5, 3], np.uint64), ([3], np.uint64), ([7], np.uint32))))
    assert [c.tolist() for c in words] == [[3, 5], [8, 1]]


def test_lm(make_docs, odd_rows, prose):
    data = [r for r in odd_rows if r[0] is not None] + [(100 + i, prose(i % 9, 80)) for i in range(30)]
    docs = make_docs(data)
    held = tx.crc_mod("doc_id", 7) == 2
    m = lm_score.fit(docs.filter(~held), bits_per_entry=512)  # so wide that it has no false positive here
    train, two, three = lm_counts(t for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2)
    starts = train.pop(b"")
    total, distinct = sum(train.values()), len(train)
    assert (m.total, m.distinct) == (total, distinct)
    got = rows(lm_score.score(docs, m, keep=["doc_id"]))
    assert len(got) == len(data)
    text, same = dict(data), 0
    for r in got:
        w = lm_words(text[r["doc_id"]])
        assert r["n_tokens"] == len(w) and r["n_known"] == sum(train[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (total + distinct + 1)) for x in w), abs=1e-6)
        full, score = [b"", *w], 0.0
        for i, x in enumerate(w):
            h = starts if i == 0 else train[full[i]]
            hw = floor_of_level(two[full[i], x])
            gh = floor_of_level(two[full[i - 1], full[i]]) if i else 0
            ghw = floor_of_level(three[full[i - 1], full[i], x]) if i else 0
            p = ((train[x] + 1) / (total + distinct + 1), hw / max(h, 1), ghw / max(gh, 1))
            weight = m.mix[64 + int(math.log2(gh)) if gh else int(math.log2(max(h, 1)))] if h else (1, 0, 0)
            score += math.log10(sum(a * b for a, b in zip(weight, p, strict=True)))
        same += r["score"] == pytest.approx(score, abs=1e-6)
    assert same == len(got)
    repeated = [r for r in got if r["doc_id"] >= 100]
    assert sum(r["score"] for r in repeated) > sum(r["base_score"] for r in repeated)  # repeated texts: n-grams help
    small = lm_score.fit(docs.filter(~held), bits_per_entry=512, shard_bytes=1)
    assert len(small.shards) > 1
    assert sorted((r["doc_id"], r["score"]) for r in rows(lm_score.score(docs, small, keep=["doc_id"]))) == sorted((r["doc_id"], r["score"]) for r in got)


def test_lm_weights_of_all_training_texts(make_docs, prose):
    """The weights are those of EM over the tokens of every training text, up to the width of the cells."""
    texts = [prose(i % 40, 12) if i % 3 else prose(10_000 + i, 12) for i in range(1200)]
    m = lm_score.fit(make_docs(list(enumerate(texts))))
    p = lm_score.read_tokens([t.encode() for t in texts])
    c = {k: np.maximum(v - 1, 0) for k, v in lm_score.statistics(p, lm_score.counts_of([p], m)[0], m).items()}
    kind, p1, p2, p3 = lm_score.parts(c, m)
    want = lm_score.weights_by_em(kind, np.stack([np.ones(len(p1)), p2 / p1, p3 / p1], axis=1), np.ones(len(p1)))
    assert len(np.unique(kind)) > 2 and np.abs(want - np.repeat(lm_score.FIRST, 64, axis=0)).max() > 0.05
    assert m.mix == pytest.approx(want, abs=5e-3) and m.mix.sum(1) == pytest.approx(np.ones(128))


def test_lm_em_raises_likelihood():
    rng = np.random.default_rng(4)
    kind, ratio, n = rng.integers(0, 128, 400), rng.gamma(0.5, 4, (400, 3)), rng.integers(1, 1000, 400)
    ratio[:, 0] = 1
    value = [(n * np.log((lm_score.weights_by_em(kind, ratio, n, r)[kind] * ratio).sum(1))).sum() for r in (0, 1, 3, 15)]
    assert value == sorted(value) and value[-1] > value[0]


def test_lm_pairs_seen_once(make_docs, prose):
    """N-grams seen once count once; larger counts are read as floors of their level."""
    texts = [prose(i, 25) for i in range(20)] + [prose(0, 25)] * 6
    _, two, three = lm_counts(texts)
    m = lm_score.fit(make_docs(list(enumerate(texts))), bits_per_entry=48)
    p = lm_score.read_tokens([t.encode() for t in texts])
    got = lm_score.statistics(p, lm_score.counts_of([p], m)[0], m)
    full = [[b"", *lm_words(t)] for t in texts]
    want_two = np.array([floor_of_level(two[x]) for w in full for x in zip(w, w[1:], strict=False)])
    want_three = np.array([floor_of_level(three[w[i - 2], w[i - 1], w[i]]) if i > 1 else 0 for w in full for i in range(1, len(w))])
    assert (want_two == 1).sum() > 100 and (want_three == 1).sum() > 100
    assert (got["hw"] == want_two).mean() > 0.99 and (got["ghw"] == want_three).mean() > 0.99


def test_lm_filter_counts():
    """Every stored count comes back as the floor of its level; absent keys rarely do; counts beyond 2 ** 32 stay whole."""
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    counts = rng.integers(1, 1000, len(keys))
    counts[:3] = 5_000_000_000, 2**31 + 5, 2**40
    m = lm_score.Model(1)
    short = keys & np.uint64(2**32 - 1)
    seg = lm_score.segment(short, counts, lm_score.PAIRS, m)
    shard = lm_score.make_shard([{"bucket": 0, "kind": lm_score.PAIRS, "keys": seg.tobytes(), "counts": b""}], 0, 1)

    def ask(k):
        out = np.zeros(len(k), np.uint8)
        lm_score.look_up(shard, m, lm_score.PAIRS, k, out)
        return np.array([0, *(lm_score.level_count(j, 1.5) for j in range(1, 100))])[out]

    found, want = ask(keys), np.array([floor_of_level(int(n)) for n in counts])
    assert (found >= want).all() and (found == want).mean() > 0.97 and (want <= counts).all()
    assert (found[:3] > 2**31 / 1.5).all() and found[2] > 2**39
    assert (ask(np.sort(rng.integers(0, 2**63, 20_000).astype(np.uint64))) > 0).mean() < 0.03


def test_lm_large_counts(spark, make_docs):
    """Counts of more than 2 ** 32 give probabilities, not negative numbers."""
    import pyarrow as pa

    docs = make_docs([(1, "a b a b a b"), (2, "b a")])
    m = lm_score.fit(docs)

    def larger(t):
        shard = t.value
        big = lm_score.Shard(shard.lo, shard.hi, shard.words, shard.counts.astype(np.int64) * 3_000_000_000, shard.bits, shard.starts)
        return spark.sparkContext.broadcast(big)

    m.shards, m.total = [larger(b) for b in m.shards], m.total * 3_000_000_000
    keys = np.array([1, 2], np.uint64)
    piece = pa.table({"bucket": [0, 0], "kind": pa.array([2, 2], pa.int8()), "once": [b"", b""], "more": [keys.astype(np.uint32).tobytes()] * 2, "counts": [np.full(2, 2**32 - 1, np.uint32).tobytes()] * 2})
    summed = lm_score.add_up(spark.createDataFrame(piece.to_pandas(), "bucket int, kind byte, once binary, more binary, counts binary"), m).first()
    assert summed["total"] == 4 * (2**32 - 1) and summed["n"] == 2
    for r in rows(lm_score.score(docs, m)):
        assert np.isfinite(r["score"]) and r["score"] < 0 and r["base_score"] < 0


def test_lm_empty(make_docs, odd_rows):
    m = lm_score.fit(make_docs([]))
    assert (m.total, m.distinct) == (0, 0)
    got = rows(lm_score.score(make_docs(odd_rows), m))
    assert len(got) == len(odd_rows) and all(r["n_known"] == 0 and np.isfinite(r["score"]) for r in got)
    assert lm_score.score(make_docs([]), m).count() == 0


def test_word_hashes(odd_rows, prose):
    """Equal words have equal hashes wherever they stand, and others don't."""
    texts = [(t or "").encode() for _, t in odd_rows] + [b"ab ba", b"a b ab", b"AB aB \x00 \x00\x00", b"x" * 600_000 + b" y", prose(3, 200_000).encode()]
    for lower in (True, False):
        ids, offsets, vocab = tx.tokenise(texts, lower)
        got, at = tx.word_hashes(texts, lower)
        assert at.tolist() == offsets.tolist()
        assert len(set(zip(ids.tolist(), got.tolist(), strict=True))) == len(vocab) == len(np.unique(got))
    assert tx.word_hashes([])[1].tolist() == [0] and tx.word_hashes([b"", b" "])[1].tolist() == [0, 0, 0]


# op5


@pytest.fixture(scope="module")
def languages():
    import duckdb

    d = "/root/testdata/sf0.01"
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{d}/documents.parquet' ORDER BY 1").fetchall()


def test_language_held_out(languages):
    train = [(lang, t.encode()) for i, t, lang in languages if i % 4]
    m = language_id.train(train)
    test = [(t.encode(), lang) for i, t, lang in languages if not i % 4]
    got, score, _ = language_id.label_texts([t for t, _ in test], m)
    assert np.mean([g == lang for g, (_, lang) in zip(got, test, strict=True)]) >= 0.97
    assert ((score >= 0) & (score <= 1)).all()


def test_language_spans(languages):
    m = language_id.train([(lang, t.encode()) for _, t, lang in languages])
    pick = lambda lang: next(t for _, t, x in languages if x == lang and len(t) > 3000).split()[:50]
    mixed = " ".join(pick("en") + pick("de") + pick("fr"))
    _, _, (spans,) = language_id.label_texts([mixed.encode()], m)
    assert [s[0] for s in spans] == ["en", "de", "fr"]
    assert all(abs(s[1] - 50 * i) <= 3 for i, s in enumerate(spans)) and sum(s[2] for s in spans) == 150


def test_viterbi_brute_force():
    import itertools

    rng = np.random.default_rng(5)
    for _ in range(30):
        lens = rng.integers(0, 6, 4)
        offsets = np.concatenate([[0], np.cumsum(lens)])
        emit = -rng.random((7, 3)).astype(np.float32) * 4
        ids = rng.integers(0, 7, offsets[-1])
        got = language_id.viterbi(emit, ids, offsets, 1.5)
        value = lambda p, e: sum(e[t, x] for t, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))
        for a, z in zip(offsets, offsets[1:], strict=False):
            if z > a:
                e = emit[ids[a:z]]
                best = max(value(p, e) for p in itertools.product(range(3), repeat=int(z - a)))
                assert value(got[a:z].tolist(), e) == pytest.approx(best, abs=1e-4)


def test_many_languages():
    """Two hundred languages of their own words, and the last ones as well known as the first."""
    rng = random.Random(8)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(40)] for _ in range(200)]
    data = [(f"l{k:03}", " ".join(rng.choices(words[k], k=60)).encode()) for k in range(200) for _ in range(3)]
    got, _, _ = language_id.label_texts([t for _, t in data], language_id.train(data))
    assert np.mean([a == b for a, (b, _) in zip(got, data, strict=True)]) > 0.99


def naive_language(train, text, bits=22):
    """Scores of a text's words by language and the best labels, without hashing, vectors or dynamic programming."""
    import itertools

    langs = sorted({x for x, _ in train})
    grams = lambda w: [(n, w[i : i + n]) for n in (1, 2, 3, 4) for i in range(len(w) - n + 1)] + [("w", w)]
    counts = {x: Counter() for x in langs}
    for x in langs:
        seen = Counter(w.lower() for own, t in train if own == x for w in t.split())
        for w, n in seen.items():
            for g in grams(f"^{w}$"):
                counts[x][g] += math.sqrt(n)
    used = len({g for c in counts.values() for g in c})
    prob = lambda x, g: math.log((counts[x][g] + 0.2) / (sum(counts[x].values()) + 0.2 * used + 1))
    words = text.split()
    score = [[0.5 * sum(prob(x, g) for g in grams(f"^{w.lower()}$")) for x in langs] for w in words]
    score = [[max(v - max(row), -8.0) for v in row] for row in score]
    value = lambda p: sum(score[t][x] for t, x in enumerate(p)) - 6.0 * sum(a != b for a, b in zip(p, p[1:], strict=False))
    path = max(itertools.product(range(len(langs)), repeat=len(words)), key=value)
    letters = [sum(len(w) for w, x in zip(words, path, strict=True) if x == k) for k in range(len(langs))]
    return langs[letters.index(max(letters))], score, value(path)


def test_language_brute_force():
    train = [("en", "the cat and the dog run over there"), ("de", "der hund und die katze laufen dorthin"), ("fr", "le chien et le chat courent par ici")]
    m = language_id.train([(x, t.encode()) for x, t in train], bits=22)
    for text in ("the dog laufen", "le chat courent the cat", "hund katze und dog", "unknown words zzz", "der the le", "katzen chats dogs"):
        want, score, best = naive_language(train, text)
        emit, _ = language_id.word_scores([w.encode() for w in text.split()], m)
        order = [sorted(x for x, _ in train).index(x) for x in m.langs]
        assert emit == pytest.approx(np.array(score)[:, order], abs=1e-3)
        assert language_id.label_texts([text.encode()], m)[0] == [want]


def test_language_changes_inside_words():
    """Text without spaces is cut where its script changes; other words stay whole."""
    assert language_id.script_runs("日本語abcд1!е".encode()) == [x.encode() for x in ("日本語", "abc", "д1!е")]
    assert language_id.script_runs("naïve-été2".encode()) == ["naïve-été2".encode()]
    train = [("zh", "中文文本没有空格 这是中文 文本".encode()), ("en", b"some plain english words here and there"), ("ru", "это русский текст".encode())]
    m = language_id.train(train)
    pred, _, (spans, _) = language_id.label_texts(["这是中文文本englishwordshereandthere没有空格中文文本这是中文文本这是".encode(), b""], m)
    assert [x[0] for x in spans] == ["zh", "en", "zh"] and pred == ["en", "und"]
    ids, offsets, vocab = language_id.tokens(["a это b中文c".encode(), b"", "中文 a".encode()])
    assert [vocab[i].decode() for i in ids] == ["a", "это", "b", "中文", "c", "中文", "a"] and offsets.tolist() == [0, 5, 5, 7]


def test_language_sample_bounds(make_docs, prose):
    data = [(i, prose(i, 30)) for i in range(60)] + [(0, prose(1000 + i, 30)) for i in range(300)]
    docs = make_docs(data, {i: ("aa", "bb", "cc")[i % 3] for i in range(60)})
    seen = []
    keep, language_id.train = language_id.train, lambda rows: seen.append(rows)
    try:
        language_id.fit(docs, per_lang=7)
        language_id.fit(docs, max_bytes=3000)
    finally:
        language_id.train = keep
    assert Counter(x for x, _ in seen[0]) == {"aa": 7, "bb": 7, "cc": 7}
    assert all(sum(len(t) for x, t in seen[1] if x == lang) < 1000 + 400 for lang in ("aa", "bb", "cc"))


def test_language_odd(make_docs, odd_rows):
    docs = make_docs(odd_rows + [(30, "привет мир как дела"), (31, "12 34 !!")], {30: "ru", 5: "en", 6: "en", 7: "xx"})
    m = language_id.fit(docs)
    assert m.langs == ["en", "ru", "xx"]
    got = {r["doc_id"]: r for r in rows(language_id.identify(docs, m))}
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 for i in (1, 2, 3, 31))
    assert got[30]["lang_pred"] == "ru" and got[30]["spans"][0]["n_tokens"] == 4
    none = language_id.fit(make_docs(odd_rows))
    assert {r["lang_pred"] for r in rows(language_id.identify(docs, none))} == {"und"}
    assert language_id.identify(make_docs([]), m).count() == 0


# op6


def test_toxicity_held_out(languages):
    import duckdb

    d = "/root/testdata/sf0.1"
    data = duckdb.sql(f"SELECT doc_id, text, toxic FROM '{d}/documents.parquet' JOIN '{d}/labels.parquet' USING (doc_id) ORDER BY 1").fetchall()
    train = [(t.encode(), y) for i, t, y in data if i % 5]
    test = [(t.encode(), y) for i, t, y in data if not i % 5]
    y = np.array([v for _, v in train])
    back = np.arange(len(y)) % 5 == 2
    pick = lambda m: ([t for (t, _), ok in zip(train, m, strict=True) if ok], y[m])
    net = toxicity.train(*pick(~back))
    toxicity.calibrate(net, *pick(back))
    s, truth = toxicity.score_texts(net, [t for t, _ in test]), np.array([v for _, v in test])
    assert ((s >= 0.5) & (truth == 0)).sum() / (truth == 0).sum() < 0.02
    assert ((s >= 0.5) & (truth == 1)).sum() / (truth == 1).sum() > 0.85


def doubles(net):
    """The same net in double precision."""
    net.table, net.v, net.c = net.table.astype(float), net.v.astype(float), float(net.c)
    net.w, net.b = {k: w.astype(float) for k, w in net.w.items()}, {k: b.astype(float) for k, b in net.b.items()}
    return net


def brute_logit(net, words):
    """Convolution and pooling word by word; beyond the text's end stands nothing."""
    vector = lambda w: sum((net.table[r] for r in net.rows(toxicity.word_features([w]))[0]), np.zeros(toxicity.DIM))
    x = [vector(w) for w in words]
    pooled = []
    for k in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = -np.inf
            for start in range(len(words) + 1):
                value = net.b[k][f]
                for j in range(k):
                    if start + j < len(words):
                        value += sum(net.w[k][j][e][f] * x[start + j][e] for e in range(toxicity.DIM))
                best = max(best, value)
            pooled.append(max(best, 0.0))
    return sum(v * h for v, h in zip(net.v, pooled, strict=True)) + net.c


def test_toxicity_convolution(prose):
    texts = [prose(1, 9), "", "one", "two words", prose(2, 14), "unseen tokens here " + prose(3, 4)]
    keys = np.unique(toxicity.word_features([w.encode() for t in texts[:5] for w in t.split()]))
    net = doubles(toxicity.Net(keys[keys != 0]))
    net.table *= 40
    net.b = {k: np.linspace(-0.5, 0.5, toxicity.FILTERS) for k in toxicity.WIDTHS}
    ids, offsets, vocab = tx.tokenise([t.encode() for t in texts])
    assert net.logits(ids, offsets, vocab) == pytest.approx([brute_logit(net, t.encode().split()) for t in texts], abs=1e-9)


def test_toxicity_finite_differences(prose):
    rng = np.random.default_rng(3)
    texts = [prose(i, n).encode() for i, n in enumerate((7, 1, 12, 3, 5))] + [b""]
    ids, offsets, vocab = tx.tokenise(texts)
    net = doubles(toxicity.Net(np.arange(1, 3, dtype=np.uint64)))
    net.b = {k: rng.uniform(-1, 1, toxicity.FILTERS) for k in toxicity.WIDTHS}  # away from the kink at 0
    x = np.vstack([rng.standard_normal((len(vocab), toxicity.DIM)), np.zeros((1, toxicity.DIM))])
    ids, offsets = toxicity.padded(ids, offsets, len(vocab))
    labels, weight = np.array([0, 1, 1, 0, 1, 0]), rng.uniform(0.5, 3, 6)
    ask = lambda: toxicity.gradients(net, x, ids, offsets, labels, weight)
    _, grad, dx = ask()

    def slope(a, at, step=1e-6):
        keep, out = a[at], []
        for s in (step, -step):
            a[at] = keep + s
            out.append(ask()[0])
        a[at] = keep
        return (out[0] - out[1]) / (2 * step)

    arrays = {"v": (net.v, grad["v"]), "x": (x[:-1], dx)} | {f"{n}{k}": (getattr(net, n)[k], grad[f"{n}{k}"]) for n in "wb" for k in toxicity.WIDTHS}
    for a, g in arrays.values():
        for _ in range(12):
            at = tuple(int(rng.integers(n)) for n in a.shape)
            assert slope(a, at) == pytest.approx(g[at], abs=1e-6)
    net.c += 1e-6
    up = ask()[0]
    net.c -= 2e-6
    assert (up - ask()[0]) / 2e-6 == pytest.approx(grad["c"], abs=1e-6)


def test_toxicity_sample(spark, make_docs, prose):
    data = [(i, prose(i, 20)) for i in range(40)] + [(3, "aaa first"), (None, "nobody")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(make_docs(data), labels)
    assert [(i, y) for i, _, y in got] == [(i, i % 2) for i in range(40)] and got[3][1] == b"aaa first"
    few = toxicity.labelled_sample(make_docs(data), labels, max_bytes=1000)
    assert all(500 <= sum(len(t) for _, t, y in few if y == kind) < 500 + 200 for kind in (0, 1))
    assert Counter(y for _, _, y in toxicity.labelled_sample(make_docs(data), labels, per_class=6)) == {0: 6, 1: 6}


def test_toxicity_whole_texts():
    """The score follows the words, whatever the text's length, and pieces don't change it."""
    texts = [b"good words here and there", b"good words bad awful here and there"] * 40
    net = toxicity.train(texts, np.array([0, 1] * 40))
    toxicity.calibrate(net, texts, np.array([0, 1] * 40))
    far = b"good words here and there " * 5000
    s = toxicity.score_texts(net, [b"", b"good words here", b"bad awful words", far, far + b" bad awful words here"])
    assert s[1] < 0.5 < s[2] and s[3] < 0.5 < s[4] and s[0] < 0.5
    one = [toxicity.score_texts(net, [t])[0] for t in (b"good words here", far + b" bad awful words here")]
    assert one == pytest.approx([s[1], s[4]], abs=1e-5)


def test_toxicity_odd(spark, make_docs, odd_rows, prose):
    labels = lambda data: spark.createDataFrame(data, "doc_id long, toxic int")
    docs = make_docs(odd_rows + [(100 + i, prose(i, 30) + (" scumword" if i % 2 else "")) for i in range(60)])
    marks = [(100 + i, i % 2) for i in range(40)] + [(7, None), (8, 0), (8, 1), (999, 1)]
    net = toxicity.fit(docs, labels(marks))
    got = rows(toxicity.score(docs, net))
    assert len(got) == len(odd_rows) + 60 and all(0 <= r["toxic_score"] <= 1 for r in got)
    tail = {r["doc_id"]: r["toxic_score"] for r in got if r["doc_id"] and r["doc_id"] >= 140}
    assert np.mean([(tail[i] >= 0.5) == (i % 2 == 1) for i in tail]) >= 0.9
    assert toxicity.fit(docs, labels([])) is None and toxicity.fit(docs, labels([(100, 0)])) is None
    assert {r["toxic_score"] for r in rows(toxicity.score(docs, None))} == {0.0}
    assert toxicity.score(make_docs([]), net).count() == 0


# op7


def brute_groups(texts, k=5, percent=75, sets=None):
    """A number for each text, the same for texts that links connect."""
    sets = [] if sets is None else sets
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(tx.LOWER))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(sets))]


def brute_components(data):
    sets = []
    group = brute_groups([t for _, t in data], sets=sets)
    least = {}
    for (d, _), g in zip(data, group, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return Counter((d, len(s), least.get(g)) for (d, _), s, g in zip(data, sets, group, strict=True))


def family(prose, seed, size, words, edits, base):
    rng = random.Random(seed)
    body = prose(seed, words).split()
    for i in range(size):
        w = list(body)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{seed}x{rng.randrange(edits * 3)}"
        yield base + i, " ".join(w)


@pytest.mark.parametrize("frequent", [2, 4, 32])
def test_jaccard_brute_force(make_docs, odd_rows, prose, frequent):
    data = odd_rows + [*family(prose, 1, 60, 120, 8, 1000), *family(prose, 2, 40, 40, 3, 2000), *family(prose, 3, 25, 14, 2, 3000), *family(prose, 4, 30, 300, 40, 4000)]
    shared = prose(9, 60)
    data += [(5000 + i, shared + " " + prose(500 + i, 30)) for i in range(30)] + [(6000 + i, prose(i % 4, 6 + i % 3)) for i in range(20)]
    got = jaccard_join.near_components(make_docs(data), frequent=frequent, bucket_bytes=2000)
    assert Counter(tuple(r.values()) for r in rows(got)) == brute_components(data)


def test_jaccard_tiny_filter(make_docs, prose):
    """A filter that errs on nearly every shingle costs time, not links; its shards don't matter."""
    data = [*family(prose, 1, 30, 120, 8, 1000), *family(prose, 2, 30, 40, 3, 2000)]
    for sizes in ({"max_filter_bytes": 64}, {"shard_bytes": 1}):
        got = jaccard_join.near_components(make_docs(data), **sizes)
        assert Counter(tuple(r.values()) for r in rows(got)) == brute_components(data)


def test_jaccard_empty(make_docs):
    assert jaccard_join.near_components(make_docs([])).count() == 0
    got = rows(jaccard_join.near_components(make_docs([(1, None), (2, ""), (3, "a"), (4, "A"), (None, "a")])))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (None, 1, 3)])


def test_common():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, n).astype(np.uint64)) for n in (0, 5, 50, 300, 300, 100, 80)]
    got = jaccard_join.common(sets[:4], sets[2:], dense=3, width=16)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets[:4]]


# pipeline


def test_pipeline(spark, tmp_path, make_docs, prose):
    base = [(i, prose(i, 40 + i)) for i in range(40)]
    bad = [(100 + i, prose(200 + i, 30) + " scumword vile") for i in range(20)]
    data = base + bad + [(300, base[3][1]), (301, base[3][1].replace(" ", "  ")), (302, " ".join(base[20][1].split()[:-1] + ["zz"])), (303, None), (304, "short"), (305, "# " * 50)]
    docs = make_docs(data).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 300)) for i, _ in base[:30] + bad[:15]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "exact_dedup", "jaccard_join", "packing"]
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stage(spark, now, str(tmp_path)).cache()
        seen.append(name)
        if name != "packing":
            assert now.columns == docs.columns
            assert now.join(before, "doc_id", "left_anti").count() == 0
    kept = {r["doc_id"] for r in rows(now)}
    assert kept == {i for i, _ in base}
    assert {r["doc_id"] for r in rows(corpus_pipeline.run(spark, str(tmp_path)))} == kept


def test_pipeline_keeps_columns_that_clash(spark, tmp_path, make_docs, prose):
    docs = make_docs([(i, prose(i, 40)) for i in range(3)])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


CLASHES = ["_row", "_kept", "_dedup_key", "_id", "row", "name", "rank", "t", "len", "pre", "sha", "n", "key", "none", "h"]


def test_pipeline_keeps_internal_names(spark, tmp_path, prose):
    docs = spark.createDataFrame([(i, prose(i, 40), *(f"{c}{i}" for c in CLASHES)) for i in (1, 2, 3)] + [(4, prose(1, 40), *CLASHES)], ["doc_id", "text", *CLASHES])
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        want = docs if name in ("quality_rules", "toxicity") else docs.filter("doc_id < 4")
        assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def many_odd(odd_rows, prose):
    """Odd rows, ids that repeat with other texts, null ids with and without copies, near copies."""
    near = [*family(prose, 1, 12, 60, 2, 1000), *family(prose, 2, 9, 30, 2, 2000)]
    return odd_rows + near + [(1003, prose(77, 50)), (1003, near[3][1]), (2001, near[0][1]), (3, prose(2, 60)), (None, prose(5, 40)), (None, prose(5, 40)), (None, prose(2, 60)), (None, near[1][1]), (20, prose(5, 40) + " x"), (None, None)]


def test_stage_exact_dedup(spark, make_docs, odd_rows, prose):
    data = many_odd(odd_rows, prose)
    got = rows(corpus_pipeline.distinct_texts(spark, make_docs(data), ""))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for i, t in data:
        least.setdefault(norm(t), []).append((i is None, i or 0))
    assert Counter((r["doc_id"], norm(r["text"])) for r in got) == Counter((None if min(g)[0] else min(g)[1], t) for t, g in least.items())


def test_stage_near_copies(spark, make_docs, odd_rows, prose):
    data = many_odd(odd_rows, prose)
    got = rows(corpus_pipeline.one_of_group(spark, make_docs(data), ""))
    distinct = sorted(set(data), key=repr)
    groups = brute_groups([t for _, t in distinct])
    want = Counter()
    for g in set(groups):
        ids = [distinct[i][0] for i in range(len(distinct)) if groups[i] == g]
        want[min((x for x in ids if x is not None), default=None)] += 1
    assert Counter(r["doc_id"] for r in got) == want
    found = [(r["doc_id"], r["text"]) for r in got]
    assert len(set(found)) == len(found) and set(found) <= set(data)
    assert len({groups[distinct.index(x)] for x in found}) == len(found)  # one of each group


def test_repeated_id_with_another_text(spark, make_docs, prose):
    same, other = prose(1, 40), prose(2, 40)
    for stage in (corpus_pipeline.distinct_texts, corpus_pipeline.one_of_group):
        got = stage(spark, make_docs([(3, same), (8, same), (8, other)]), "")
        assert sorted((r["doc_id"], r["text"]) for r in rows(got)) == [(3, same), (8, other)]


def test_stage_quality(spark, make_docs, odd_rows, prose):
    data = many_odd(odd_rows, prose) + [(i, prose(i, 12)) for i in range(9000, 9010)]
    got = rows(corpus_pipeline.quality(spark, make_docs(data), ""))

    def fine(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        twice = {i + j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(5)}
        chars = sum(map(len, w))
        shout = sum(x == x.upper() and x != x.lower() for x in w)
        return not (len(w) < 10 or 100 * len(twice) > 20 * len(w) or 100 * len(re.findall(r"[#*$%&|<>]", t)) > 30 * len(w) or 100 * (len(lines) - len(set(lines))) > 50 * len(lines) or 100 * shout > 50 * len(w) or not 2 * len(w) <= chars <= 14 * len(w))

    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(x for x in data if fine(x[1]))


def test_pipeline_empty(spark, tmp_path, make_docs):
    make_docs([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_policies_cover_rules():
    assert quality_rules.mask("v1") == (1 << len(quality_rules.RULES)) - 1
