"""Rows that share an id, or have none, and differ in their texts."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers

import pytest
from pyspark.sql import functions as F

from corollary.llm import embedding_dedup, exchange, language_id, line_dedup, lm_scoring, minhash_dedup, packing, quality, sentencepiece_bpe, substring_dedup, toxicity


def numbered(name, n):
    return [f"{name}{k}" for k in range(n)]


@pytest.mark.parametrize("chunks, fan", [(1, 256), (5, 256), (5, 2)])
def test_substring_dedup_by_row(spark, empty, chunks, fan, monkeypatch):
    monkeypatch.setattr(substring_dedup, "chunk_count", lambda d: chunks)
    monkeypatch.setattr(exchange, "FAN", fan)
    p, q = numbered("p", 25), numbered("q", 25)
    rows = [
        (None, p + numbered("a", 30) + p), (None, numbered("b", 90)), (None, numbered("c", 10)),
        (7, q + numbered("d", 30) + p), (7, numbered("e", 90)), (7, q + numbered("f", 30) + q), (7, []), (9, q), (11, numbered("e", 90)[50:80] + numbered("g", 9)),
    ]
    first = {}
    for d, w in rows:
        place = -1 if d is None else d
        for s in range(len(w) - 19):
            key = tuple(w[s : s + 20])
            first[key] = min(first.get(key, (place, s)), (place, s))
    want = []
    for d, w in rows:
        gone = {s + o for s in range(len(w) - 19) for o in range(20) if first[tuple(w[s : s + 20])] != (-1 if d is None else d, s)}
        want.append((d, [x for k, x in enumerate(w) if k not in gone]))
    assert [len(k) for _, k in want] == [55, 90, 10, 55, 90, 55, 0, 0, 9]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["kept_sha256"]) for r in substring_dedup.digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(((d, hashlib.sha256(" ".join(k).encode()).hexdigest()) for d, k in want), key=repr)
    got = [(r["doc_id"], r["text"].split()) for r in substring_dedup.remove(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_line_dedup_by_row(spark, empty):
    w = lambda name, n=10: " ".join(numbered(name, n))
    near = lambda name: w(name) + " other"
    rows = [
        (None, [w("a"), w("b")]), (None, [w("c"), "", near("a")]), (1, [w("d"), near("b"), w("e")]),
        (5, [w("f"), w("g")]), (5, [w("h"), w("i"), w("j")]), (5, [near("f"), near("d"), w("f")]), (5, [w("f"), w("g")]), (5, None), (6, [near("j"), w("k")]),
    ]
    flat = [(-1 if d is None else d, k, frozenset(x.split())) for d, lines in rows for k, x in enumerate(lines or []) if x]
    want = []
    for d, lines in rows:
        place, kept = -1 if d is None else d, []
        for k, x in enumerate(lines or []):
            s = frozenset(x.split())
            if not s or not any((e, j) < (place, k) and 100 * len(s & t) >= 80 * len(s | t) for e, j, t in flat):
                kept.append(x)
        n = sum(bool(x) for x in lines or [])
        want.append((d, n, n - sum(bool(x) for x in kept), None if lines is None else "\n".join(kept)))
    assert [r for _, _, r, _ in want] == [0, 1, 1, 0, 0, 2, 0, 0, 1]
    docs = spark.createDataFrame([(d, lines and "\n".join(lines)) for d, lines in rows], "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup.digests(docs).collect()]
    assert sorted(got, key=repr) == sorted(((d, n, r, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, r, t in want), key=repr)
    got = [(r["doc_id"], r["text"]) for r in line_dedup.remove(docs).collect()]
    assert sorted(got, key=repr) == sorted(((d, t) for d, _, _, t in want), key=repr)


def near_by_row(rows, n, percent):
    """Components of rows (id, text), by place, and the smallest id of each row's component."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, s in enumerate(sets):
        for b in range(a):
            if s and sets[b] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(s & sets[b]) >= percent * len(s | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    roots = [find(k) for k in range(len(rows))]
    return sets, [None if d is None else min(rows[j][0] for j in range(len(rows)) if roots[j] == roots[k]) for k, (d, _) in enumerate(rows)]


def one_word_off(words, rng):
    w = list(words)
    w[rng.randrange(len(w))] = f"other{rng.randrange(10**6)}"
    return w


@pytest.mark.parametrize("block", [2, 2048])
def test_minhash_by_row(spark, block):
    rng = random.Random(12)
    a, b, c = numbered("a", 80), numbered("b", 80), numbered("c", 70)
    rows = [(1, a), (5, a), (5, b), (5, one_word_off(a, rng)), (5, a), (7, c), (8, one_word_off(b, rng)), (8, numbered("d", 60)), (None, a), (9, []), (9, None), (9, c[:2]), (10, c[:2])]
    rows += [(20 + k % 3, one_word_off(a, rng)) for k in range(9)]
    rows = [(d, w if w is None else " ".join(w)) for d, w in rows]
    sets, smallest = near_by_row(rows, 3, 85)
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, mark int").repartition(3)
    got = minhash_dedup.near_duplicates(docs, shingle=3, percent=85, block=block).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=repr) == sorted(((d, len(s), c, c == d) for (d, _), s, c in zip(rows, sets, smallest, strict=True)), key=repr)
    kept = minhash_dedup.keep_first(docs, shingle=3, percent=85, block=block)
    assert kept.columns == docs.columns
    assert sorted(r["mark"] for r in kept.collect()) == [k for k, ((d, _), c) in enumerate(zip(rows, smallest, strict=True)) if d is None or c == d]


def test_a_large_weak_group_is_not_compared_pair_by_pair(spark, monkeypatch):
    """Documents that share bands with some others each, so that bands alone tie all into one group, and pairs that link."""
    rng, rows = random.Random(13), []
    for k in range(400):
        w = [f"w{j}" for j in range(20 * k, 20 * k + 120)]
        rows.append((2 * k, " ".join(w)))
        if k % 10 == 0:
            rows.append((2 * k + 1, " ".join(one_word_off(w, rng))))
    compared = []
    plain = minhash_dedup.Pairwise.apart

    def counting(self, *args):
        out = plain(self, *args)
        n = out.groupBy(out.columns[0] if out.columns[0] in ("band", "group") else args[1], "a", "b").agg(F.sum(F.col("asks").cast("long")).alias("x"), F.count("*").alias("n"))
        compared.append(n.select(F.sum(F.col("x") * (F.col("n") - F.col("x")))).first()[0] or 0)
        return out

    monkeypatch.setattr(minhash_dedup.Pairwise, "apart", counting)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(docs, shingle=3, percent=85).collect()}
    _, smallest = near_by_row(rows, 3, 85)
    assert got == dict(zip((d for d, _ in rows), smallest, strict=True))
    assert len(compared) == 2 and sum(compared) < len(rows) ** 2 / 10


def test_embeddings_by_row(spark):
    rng = np.random.default_rng(14)
    x, y = rng.normal(size=12), rng.normal(size=12)
    near = lambda v: v + 0.02 * rng.normal(size=12)
    rows = [(1, x, 0), (1, y, 0), (2, near(x), 0), (3, near(y), 0), (3, near(y), 1), (3, x, 1), (1, x, 0), (None, x, 0), (4, rng.normal(size=12), 0)]
    rows = [(i, [float(np.float32(c)) for c in v], label) for i, v, label in rows]
    v = [np.array(r[1], np.float32).astype(float) for r in rows]
    linked = lambda a, b: a != b and rows[a][2] == rows[b][2] and rows[a][0] is not None and rows[b][0] is not None and v[a] @ v[b] / math.sqrt((v[a] @ v[a]) * (v[b] @ v[b])) >= 0.98
    links = {a: {b for b in range(len(rows)) if linked(a, b)} for a in range(len(rows))}
    want = []
    for a, (i, _, _) in enumerate(rows):
        seen, todo = {a}, [a]
        while todo:
            more = links[todo.pop()] - seen
            seen |= more
            todo += more
        smallest = None if i is None else min(rows[b][0] for b in seen)
        want.append((i, len(links[a]), smallest, smallest == i))
    got = embedding_dedup.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_whole_products_are_exact():
    rng = np.random.default_rng(15)
    a, b = (rng.choice([-127, 126, 127], (5, 9000)).astype(np.int8) for _ in range(2))
    assert (embedding_dedup.whole_products(a, b) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def test_rows_in_are_rows_out(spark, empty):
    """A row that is there twice, and rows of one id or none with other texts, in the operators that judge each row by itself."""
    rows = [(1, "you are the one of them"), (1, "you are the one of them"), (1, "der die das und ist nicht"), (None, "you are"), (None, "et le la de que"), (2, None), (2, "")]
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string").repartition(3)
    ids = Counter(d for d, _ in rows)
    for out in (
        lm_scoring.score(docs), quality.judge(docs, [0.0] * quality.BUCKETS), sentencepiece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), digests=True),
        toxicity.score(docs, toxicity.Model()), language_id.identify(docs, language_id.fit(docs)), line_dedup.digests(docs), substring_dedup.digests(docs),
    ):
        assert Counter(r["doc_id"] for r in out.collect()) == ids
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == ids and sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    by_text = Counter((r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in lm_scoring.score(docs).collect())
    assert max(by_text.values()) == 2


def test_line_dedup_with_clashing_names(spark, empty):
    docs = spark.createDataFrame([(1, "a b c d\na b c d\ne f g h", 1, 2, 3, 4, 5), (2, "E f g h", 1, 2, 3, 4, 5)], "doc_id long, text string, __doc int, __row int, __kept int, __lines int, __removed int")
    got = line_dedup.remove(docs)
    assert got.columns == docs.columns and {(r["doc_id"], r["text"], r["__kept"]) for r in got.collect()} == {(1, "a b c d\ne f g h", 3), (2, "", 3)}
