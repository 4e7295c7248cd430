"""Exact dedup, chat formatting, quality ledger, BPE, URL filter."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, chat_format, exact_dedup, quality_rules, registry, url_filter


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, same_rows, name):
    d = "/root/testdata/sf0.001"
    same_rows(registry.QUERIES[name](spark, d).toPandas(), duck(registry.ORACLES[name], d))


# op8


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_dedup_brute_force(make_docs, odd_rows, prose):
    data = odd_rows + [(100 + i, prose(i % 7, 50)) for i in range(60)] + [(200 + i, prose(5, 200) + f" {i % 3}") for i in range(20)]
    for digest_all in (True, False):
        got = rows(exact_dedup.exact_dedup(make_docs(data), digest_all=digest_all))
        groups = defaultdict(list)
        for i, t in data:
            groups[norm(t)].append(i)
        want = {hashlib.sha256(t.encode()).hexdigest(): g for t, g in groups.items()}
        assert len(got) == len(data)
        by_id = {(i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in data}
        for r in got:
            shas = [s for i, s in by_id if i == r["doc_id"]]
            group = want[r["text_sha256"] or shas[0]]
            assert r["group_size"] == len(group)
            assert r["keep_id"] == min((x for x in group if x is not None), default=None)
            assert r["text_sha256"] in shas if digest_all else r["text_sha256"] in (None, *shas)
        assert sum(r["kept"] for r in got) == len(groups)  # one row of each group, repeated rows too
    assert exact_dedup.drop_copies(make_docs(data)).count() == len(groups)


def test_dedup_empty(make_docs):
    assert exact_dedup.exact_dedup(make_docs([]), digest_all=True).count() == 0
    assert exact_dedup.drop_copies(make_docs([])).count() == 0


# op2


def chat(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    data = [
        (-1, 0, "user", said), (-1, 1, "assistant", said), (1, 0, "system", "a<|turn|>b&amp;&lt;"), (1, 1, "user", "x<|end|>\n"), (1, 2, "assistant", "<|end|><|turn|>user\nhi"), (1, 3, "user", "last"),
        (2, 0, "user", None), (2, 1, None, "t"), (3, None, "assistant", ""), (3, 0, "assistant", "two"), (4, 0, "assistant", "dup"), (4, 0, "assistant", "dup"), (None, 1, "user\nx", "y"), (None, 2, "assistant", "z" * 100_000),
    ]
    got = {r["conv_id"]: r for r in rows(chat_format.read_back(chat_format.expand_targets(chat(spark, data))))}
    convs = defaultdict(list)
    for c, turn, role, text in data:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_examples(spark):
    data = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(7)]
    ex = sorted(rows(chat_format.expand_targets(chat(spark, data))), key=lambda r: r["target"])
    assert [r["target"] for r in ex] == [1, 3, 5, 6] and [r["is_last"] for r in ex] == [False, False, False, True]
    assert [r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_length"]] for r in ex] == ["t1", "t3", "t5", ""]
    assert all(b["formatted"].startswith(a["formatted"]) for a, b in zip(ex, ex[1:], strict=False))
    assert chat_format.expand_targets(chat(spark, data[:0])).count() == 0


# op9


def brute_measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return dict(n_words=len(words), word_chars=sum(map(len, words)), n_symbols=len(re.findall(r"[#*$%&|<>]", t or "")), n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), n_caps_words=sum(w == w.upper() and w != w.lower() for w in words))


def test_quality(make_docs, odd_rows, prose):
    data = odd_rows + [(50, "a b c d e f " * 20), (51, "x# y* z$ " * 9), (52, "same line here\n" * 12), (53, prose(3, 50).upper()), (54, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa " * 12)]
    got = rows(quality_rules.apply_policy(quality_rules.ledger(make_docs(data)), "v1"))
    assert len(got) == len(data)
    want = Counter((i, *brute_measures(t).values()) for i, t in data)
    assert want == Counter((r["doc_id"], *(r[m] for m in quality_rules.MEASURES)) for r in got)
    for r in got:
        bits = sum(1 << b for b, (_, rule) in enumerate(quality_rules.RULES) if eval(f"({rule})".replace("OR", "or"), {}, r))
        assert r["failed_bits"] == bits and r["kept"] == (bits & quality_rules.mask("v1") == 0)
    assert quality_rules.ledger(make_docs([])).count() == 0


def test_ablations(make_docs, odd_rows, prose):
    data = odd_rows + [(60 + i, prose(i, 40)) for i in range(5)] + [(70, "x# y* z$ " * 9)]
    led = quality_rules.ledger(make_docs(data)).cache()
    bits = [r["failed_bits"] & quality_rules.mask("v1") for r in led.collect()]
    for r in quality_rules.ablations(led, "v1").collect():
        bit = 1 << [n for n, _ in quality_rules.RULES].index(r["rule"])
        assert (r["n_failed"], r["n_only"], r["n_rejected_without"], r["n_rejected"], r["n_documents"]) == (sum(b & bit > 0 for b in bits), bits.count(bit), sum(b & ~bit > 0 for b in bits), sum(b > 0 for b in bits), len(bits))


# op10


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.merges_of(bpe.public_ranks(), P.PATTERN).rank, special_tokens={})


def test_bpe_like_tiktoken(tiktoken_encoding):
    import random

    import public_tokenizers as P

    m = bpe.merges_of(bpe.public_ranks(), P.PATTERN)
    rng = random.Random(4)
    parts = ["a", "aa", "aaa", "ab", "  ", " ", "\n", "'s", "é", "ß", "日本", "🙂", "0", "12", "\u0301", "x" * 50, "<|endoftext|>", "!!!", " the", "ing", "th", "\u00a0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(500)] + ["", "a" * 5000, "ab" * 3000, " " * 999]
    got = bpe.encode_texts(texts, m)
    assert [x.tolist() for x in got] == [tiktoken_encoding.encode_ordinary(t) for t in texts]
    assert [bpe.decode(x, m) for x in got] == [t.encode() for t in texts]
    assert bpe.encode_texts([], m) == []


def test_bpe_query(make_docs, odd_rows, tiktoken_encoding):
    import numpy as np
    import public_tokenizers as P

    got = rows(bpe.bpe_encode(make_docs(odd_rows), bpe.public_ranks, P.PATTERN, digests=True))
    want = Counter()
    for i, t in odd_rows:
        ids = np.array(tiktoken_encoding.encode_ordinary(t or ""), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert want == Counter(tuple(r.values()) for r in got)
    plain = rows(bpe.bpe_encode(make_docs(odd_rows), bpe.public_ranks, P.PATTERN))
    assert Counter(bytes(r["decoded"]).decode() for r in plain) == Counter(t or "" for _, t in odd_rows)
    assert bpe.bpe_encode(make_docs([]), bpe.public_ranks, P.PATTERN).count() == 0


def test_bpe_pieces_share_words(prose):
    """Words that an earlier piece had, and a start anew when the room is used up, change no id."""
    m = bpe.merges_of(bpe.public_ranks(), __import__("public_tokenizers").PATTERN)
    texts = [prose(i % 5, 40) + f" new{i}" for i in range(12)]
    want = [x.tolist() for x in bpe.encode_texts(texts, m)]
    for room in (48 << 20, 5000, 0):
        done = bpe.Replayed(m, room)
        assert [x.tolist() for t in texts for x in done.encode([t])] == want


# op4


def brute_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


#: Hosts that no training URL has; some of their words are not in the training words either.
HELD_OUT = {
    "block": """
        luckycasino77 royal-poker-room vegas-slots blackjack-tables sportsbetting-tips bingo-hall-bonus roulette-wheel lotto-numbers-win
        hot-escorts-city sexchat-rooms adult-movies free-porn-clips xxxvids nude-cams erotic-stories-24 hentai-haven-mirror
        buy-viagra-cheap cialis-discount steroids-shop pills-without-rx cheap-painkillers payday-advance quickcash-loans easymoney-fast
        crypto-giveaway-now bitcoin-doubler-pro binaryoptions-robot malware-download phishing-bank trojan-dropper botnet-rent exploit-kit
        ransomware-decrypt verify-account-now torrent-mirror warezlinks crack-serials keygen-all pirated-films spam-mailer backlinks-cheap
        buy-followers-fast buylikes-insta clickbait-farm adserver7 popunder-net tracker-pixel gambling-hub replica-bags fakeid-maker freeprize-phone
    """.split(),
    "allow": """
        botanical-garden citylibrary national-museum evening-news dailyherald open-university primary-school physics-lectures
        marine-biology math-olympiad local-history weatherreport alpine-railway river-cruise mountain-huts hiking-trails badminton-club
        tenniscourt chess-problems guitar-lessons symphony-orchestra operahouse filmfestival photo-archive artschool interior-design
        bridge-architecture civil-engineering linux-kernel-docs developer-handbook database-course poetry-corner bookreviews cheese-market
        savings-bank legal-advice career-fair parents-forum dog-training organic-farm solar-panels water-works church-choir
        volunteer-firemen events-calendar street-maps wikibooks latin-dictionary language-exchange exam-papers knitting-patterns
        pottery-workshop sailing-club beekeepers astronomy-night essex-county adulteducation tracking-birds classic-cars
        carpentry sewing-machines geology-tours village-hall seaside-rentals tea-house bicycle-repair
    """.split(),
}


def test_url_model_holds_out():
    """Precision and recall on hosts that training never saw; the README gives the same figures."""
    labelled = url_filter.labelled_urls()
    seen = {url_filter.split_url(u)[0] for urls in labelled.values() for u in urls}
    w, b = url_filter.train(labelled)
    judged = {v: [] for v in HELD_OUT}
    for v, hosts in HELD_OUT.items():
        for i, h in enumerate(hosts):
            host = f"{('', 'www.', 'm.')[i % 3]}{h}.{('org', 'com', 'example.org', 'net')[i % 4]}"
            assert host not in seen
            x = url_filter.features(host, ("/", "/en/3", "/page/12.html")[i % 3])
            judged[v].append(w[x].sum() / len(x) ** 0.5 + b > 0)
    caught, wrong = sum(judged["block"]), sum(judged["allow"])
    print(caught, len(judged["block"]), wrong, len(judged["allow"]), [h for h, j in zip(HELD_OUT["block"], judged["block"], strict=True) if not j], [h for h, j in zip(HELD_OUT["allow"], judged["allow"], strict=True) if j])
    assert caught / len(judged["block"]) >= 0.85 and caught / (caught + wrong) >= 0.85
    assert b < 0  # a url without features is allowed


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://org", "http://org/", "HTTP://A.ORG/x?y#z", "http://example.org/es/1", "http://x.example.org/en/12", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/de/?q", "http://com/de/", "http://evilcom/de/", "http://poker-night.example.net/en/1", "http://library.example.net/en/1", "x://h#/org/", "http://u:p@h.org:80/a", "a://b://c/d", "http://ÀB.com/fr/ü", "http://a.net/" + "long/" * 20_000, "http://a..com/fr/", "http://.org/"]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)] + [(3, urls[3], "h", "r"), (None, urls[6], "h", "r")], "page_id long, url string, html string, rule string")
    got = rows(url_filter.url_filter(pages))
    assert len(got) == len(urls) + 2
    for r in got:
        host, path, (rule, verdict) = brute_rule(urls[6 if r["page_id"] is None else r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))
    by = {r["page_id"]: r["verdict"] for r in got}
    assert by[13] == "block" and by[14] == "allow" and by[0] == by[1] == by[2] == "allow"
    assert url_filter.url_filter(pages.limit(0)).count() == 0


def test_rule_book():
    """Thousands of rules, against trying each; of equally long rules the longer host wins; doubles are refused."""
    import random

    rng = random.Random(2)
    part = lambda: rng.choice(["a", "b", "cc", "d-d"])
    rules = sorted({(".".join(part() for _ in range(rng.randint(1, 4))), "/" + "/".join(part() for _ in range(rng.randint(0, 4)))) for _ in range(6000)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    book = url_filter.RuleBook(rules)
    assert len(rules) > 1000
    for _ in range(300):
        host, path = ".".join(part() for _ in range(rng.randint(1, 5))), "/" + "/".join(part() for _ in range(rng.randint(0, 5)))
        fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert book.fitting(host, path) == (max(fits)[2:] if fits else None)
    with pytest.raises(ValueError):
        url_filter.RuleBook([("allow", "a", "/"), ("block", "a", "/")])
