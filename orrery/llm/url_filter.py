"""URL filter: listed rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained here, from a small table of labelled URLs (labelled_urls: general words for kinds of sites, or a
table of the caller's), on the driver in numpy; what is broadcast is one weight vector of 2 ** bits floats, whatever the
input's size, and the rules, which are the caller's list. Host
and path n-grams have separate spaces, and marks at both ends of each host label and path part let whole
words be features. Scoring runs over Arrow batches, on distinct (host, path n-gram text) of the batch only.
A rule is found by the host's endings, so any number of rules costs the same.

Defined results: a url that is null or has no `://` has an empty host and path and is judged by the model's bias
alone, which is that of the more frequent verdict, allow; urls of any length are used whole; a null id is carried like
any other; repeated rows give repeated rows; an empty table gives an
empty result; rules must be distinct, and of those that fit the longest wins (host and path together; of equally
long ones that of the longer host).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm import text as tx

#: Production rules (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: What the labelled table is made of. Words for kinds of sites that a filter blocks or lets pass, and marks
#: that say nothing and stand on both sides.
BLOCKED_WORDS = """
    casino poker roulette slots jackpot blackjack betting bets bookmaker gambling gamble bingo wager lotto spins
    porn xxx sex adult nude escort camgirls erotic hentai fetish nsfw hookup playmates
    viagra cialis pills steroids painkillers dietpills cheapmeds rxpharma
    payday loans quickcash getrich easymoney bitcoindoubler cryptogiveaway binaryoptions forexsignals advance
    malware phishing trojan botnet keylogger exploit ransomware spyware verifyaccount stealer
    torrent warez crack keygen nulled pirated serials
    spam linkfarm backlinks buyfollowers buylikes clickbait trafficbot
    ads adserver popup popunder tracker clicktrack adclick redirecter
    replica counterfeit fakeid fakewatches freeprize sweepstakes freegift winbig
""".split()
ALLOWED_WORDS = """
    news daily post journal library archive museum university college school academy institute research science physics
    biology chemistry mathematics history geography weather climate travel hotel railway airport city council government
    parliament court fire hospital clinic doctor health nutrition recipes cooking kitchen bakery garden flowers trees forest
    river mountain hiking cycling football tennis badminton chess music guitar piano orchestra opera theatre cinema film photo
    gallery art painting design architecture engineering software docs developer code database cloud linux forum community
    blog notes diary stories poetry books publisher bookshop market store bank insurance accounting law legal consulting
    jobs career parents kids family pets dogs cats horses farm agriculture energy solar water environment recycling church
    charity volunteers festival events tickets calendar maps guide wiki encyclopedia dictionary translate language learning
    teacher students exam pharmacology alphabet essex sussex adulthood analysis trainspotting railtracks adventures address
    slovenia polka spinach sports pillar cracow torrential popular redcross advanced loanwords freedom freelance winter
    windows bitmap clickable expo serial-drama banner-museum tracking-parcels betsy fakir sextant middlesex
""".split()
MARKS = """
    best my the online world home web plus pro top new real central first live
""".split()
ENDS = ["com", "net", "org", "info", "example.com", "example.net"]
PATHS = ["", "/", "/index.html", "/en/12", "/page/7", "/de/31/", "/articles/2024/05", "/item?id=8", "/fr/list"]


def labelled_urls() -> dict[str, list[str]]:
    """The labelled table, by a rule: every word as a host of its own, before and after a mark, and as part of a path, each
    with endings, prefixes and paths in turn, so that these say nothing."""
    out = {}
    for verdict, words in (("block", BLOCKED_WORDS), ("allow", ALLOWED_WORDS)):
        urls = []
        for i, w in enumerate(words):
            mark, more = MARKS[i % len(MARKS)], MARKS[(3 * i + 5) % len(MARKS)]
            for j, host in enumerate((w, f"{mark}-{w}", f"{w}-{more}", f"{more}{w}", f"{w}{mark}")):
                sub = ("", "www.", "m.", "blog.")[(i + j) % 4]
                urls.append(f"http://{sub}{host}.{ENDS[(i + 2 * j) % len(ENDS)]}{PATHS[(2 * i + j) % len(PATHS)]}")
            urls.append(f"https://{mark}{more}.{ENDS[i % len(ENDS)]}/{w}/{i}")
        out[verdict] = urls
    return out


class RuleBook:
    """Rules by host; any number of them."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len({r[1:] for r in rules}) < len(rules):
            raise ValueError("two rules for one host and path")
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in sorted(rules, key=lambda r: (-len(r[2]), r[2])):
            self.by_host.setdefault(host, []).append((path, verdict))

    def fitting(self, host: str, path: str) -> tuple[str, str] | None:
        """Verdict and rule (host and path) of the longest that fits; of equally long ones that of the longer host."""
        best, found, at = -1, None, 0
        while True:
            own = host[at:]
            for p, verdict in self.by_host.get(own, ()):
                if path.startswith(p):
                    if len(own) + len(p) > best:  # longer hosts come first
                        best, found = len(own) + len(p), (verdict, own + p)
                    break
            at = host.find(".", at) + 1
            if not at:
                return found


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or no `://`."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def features(host: str, path: str, bits: int = 16, sizes: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """Hashed n-grams; each host label and each path part is bounded by marks, numbers become one mark."""
    out = set()
    for space, parts in (("h", re.split(r"[.\-]", host)), ("p", re.split(r"[/.\-_]", path))):
        for part in parts:
            if not part:
                continue
            word = f"^{re.sub(r'[0-9]+', '0', part)}$"
            for n in sizes:
                for i in range(max(1, len(word) - n + 1)):
                    out.add(zlib.crc32(f"{space}{n}{word[i : i + n]}".encode()) & ((1 << bits) - 1))
            out.add(zlib.crc32(f"{space}w{word}".encode()) & ((1 << bits) - 1))
    return np.fromiter(sorted(out), np.int64, len(out))


def split_url(url: str) -> tuple[str, str]:
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")


def train(labelled: dict[str, list[str]], bits: int = 16, epochs: int = 30, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient steps on the log loss, in a fixed order; 1 stands for block."""
    rows = [(features(*split_url(u), bits), float(v == "block")) for v in sorted(labelled) for u in labelled[v]]
    share = sum(y for _, y in rows) / max(1, len(rows))
    w, b = np.zeros(1 << bits), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(7)
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            if not len(x):
                continue
            scale = 1 / np.sqrt(len(x))
            g = (1 / (1 + np.exp(-(w[x].sum() * scale + b))) - y) * rate / (1 + epoch / 20)
            w[x] -= g * scale + rate * l2 * w[x]
            b -= g * 0.01
    return w.astype(np.float32), b


def judged(df: DataFrame, host_col: str, path_col: str, weights: np.ndarray, bias: float, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Adds block_score double, rule string and rule_verdict string (both null if no rule fits)."""
    sent = df.sparkSession.sparkContext.broadcast((weights, bias, RuleBook(rules)))
    bits = int(len(weights)).bit_length() - 1
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b, book = sent.value
        for rb in batches:
            pairs = list(zip(rb.column(host_col).to_pylist(), rb.column(path_col).to_pylist(), strict=True))
            known, score = {}, []
            for h, p in pairs:
                key = (h, re.sub(r"[0-9]+", "0", p))
                if key not in known:
                    x = features(*key, bits)
                    known[key] = 1 / (1 + np.exp(-(w[x].sum() / np.sqrt(max(1, len(x))) + b)))
                score.append(known[key])
            fits = [book.fitting(h, p) or (None, None) for h, p in pairs]
            yield tx.with_columns(rb, names, block_score=pa.array(score, pa.float64()), rule=pa.array([f[1] for f in fits], pa.string()), rule_verdict=pa.array([f[0] for f in fits], pa.string()))

    return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", block_score double, rule string, rule_verdict string")


def url_filter(pages: DataFrame, rules=RULES, labelled: dict[str, list[str]] | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, bits: int = 16) -> DataFrame:
    """id, host, path, rule (null if none fits), block_score of the model, verdict: the rule's, else the model's."""
    weights, bias = train(labelled or labelled_urls(), bits)
    split = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    scored = judged(split, "host", "path", weights, bias, rules)
    verdict = F.coalesce("rule_verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))
    return scored.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages)


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What rules alone say of every page: host, path, rule and its verdict."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = judged(split, "host", "path", np.zeros(2, np.float32), 0.0, RULES)
    return found.select("page_id", "host", "path", "rule", "rule_verdict")


RULES_SQL = r"""
WITH r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages)
SELECT page_id, host, path, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(verdict, length(h) + length(p)) AS rule_verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path
"""
