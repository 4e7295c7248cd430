import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, n_words string, toxic_score string, length string, _salt string, comp string, failed_bits string, kept string, _id string, sig string, t string, word string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from [(doc_id, text)], with columns whose names operators use inside."""

    def make(rows, langs=None):
        full = [(i, t, (langs or {}).get(i), None, None if t is None else len(t), *["x"] * 12) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


WORDS = [a + b + c for a in ("ka", "lo", "mi", "tu", "re", "san") for b in ("pi", "do", "ver", "gal") for c in ("n", "st", "o", "ra")]


@pytest.fixture(scope="session")
def prose():
    def make(seed: int, n: int) -> str:
        return " ".join(random.Random(seed).choices(WORDS, k=n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Nulls, empty and blank texts, ties, repeated rows, a very long text."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \t\n\r\x0b\x0c "), (4, "one"), (5, "One two three\nfour  five"), (6, "one Two three four\tfive"), (7, prose(2, 60)), (8, prose(2, 60)), (8, prose(2, 60)), (9, long), (10, long + " end"), (11, "née ÉTÉ 日本語 🙂 \u00a0x\u2003y"), (None, "no id here at all"), (12, "<|endoftext|> </s>[INST] ok [/INST]")]
