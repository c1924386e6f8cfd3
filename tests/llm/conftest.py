import random
import zlib

import pytest

from corollary.shipping import ship

WORDS = [f"{a}{b}{c}" for a in ("ba", "ke", "li", "mo", "tu") for b in ("na", "ro", "si", "d") for c in ("", "s", "ment", "ing")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk string, `group` int"


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Copies, near copies, shared passages, repeated lines, odd and empty texts."""
    rng = random.Random(5)
    out = {}
    for k in range(60):
        out[k] = "\n".join(sentence(rng, rng.randrange(6, 40)) for _ in range(rng.randrange(1, 5)))
    for k in range(60, 75):
        w = out[k - 60].split(" ")
        w[len(w) // 2] = "changed"
        out[k] = " ".join(w)
    for k in range(75, 85):
        out[k] = out[3]
    passage = sentence(rng, 60)
    for k in range(85, 95):
        out[k] = f"{sentence(rng, 25)} {passage} {sentence(rng, 25)}"
    line = "The very same line of several words stands here."
    for k in range(95, 100):
        out[k] = f"{sentence(rng, 15)}\n{line}\n{sentence(rng, 15)}\n{line.upper()}\n\n{line.replace('several', 'many')}"
    out |= {100: "", 101: None, 102: "one", 103: "ONE", 104: " \n\t ", 105: "a b c d e " * 30, 106: "x" * 30_000, 107: " ".join(str(k % 50) for k in range(6000)), 108: "é ß 日本 語   😀 ▁ <|endoftext|> <s>", 109: "# * $ % & | < >"}
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as a table with columns of names that operators use themselves, and a row that is there twice."""
    ship(spark)
    rows = [(k, t, "en", "s", len(t or ""), "c", k) for k, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    ship(spark)
    return spark.createDataFrame([], SCHEMA)


def crc(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def components(ids, edges):
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
