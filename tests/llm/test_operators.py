"""Each operator against brute force on small texts, with nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corollary.llm import embedding_dedup, exchange, language_id, line_dedup, lm_scoring, minhash_dedup, packing, quality, sentencepiece_bpe, substring_dedup, toxicity
from corollary.llm.common import Scratch
from corollary.llm.common import components as spark_components

from .conftest import SCHEMA, components, crc

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def words(text):
    return (text or "").encode().split()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    got = spark_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test"))
    want = components({x for e in edges for x in e}, edges)
    loops = {a for a, b in edges if a == b}
    assert {r["node"]: r["component"] for r in got.collect()} == {k: v for k, v in want.items() if k not in loops or any(k in e and e[0] != e[1] for e in edges)}


def test_lm_scoring(docs, empty, texts):
    rows = {r["doc_id"]: r for r in lm_scoring.score(docs).collect()}
    tokens = {d: [w.lower() for w in words(t)] + [None] for d, t in texts.items()}
    counts = Counter(w for d, ws in tokens.items() if crc(d, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for d, ws in tokens.items():
        r = rows[d]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(d, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base) and -1e9 < r["score"] < 0
    held = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_scoring.score(empty).count() == 0


def test_lm_mixture_is_what_em_finds():
    cells = [{"bucket": 3, "p1": -8, "p2": -4, "n": 90}, {"bucket": 3, "p1": -8, "p2": lm_scoring.NONE, "n": 10}, {"bucket": 0, "p1": lm_scoring.NONE, "p2": lm_scoring.NONE, "n": 5}]
    w = lm_scoring.mixture(cells, 1000)
    assert w[3].sum() == pytest.approx(1) and w[3][2] > w[3][1] > w[3][0] and w[0][0] > 0.99
    p = lambda a: 90 * math.log(a[0] / 1001 + a[1] / 4 + a[2] / 2) + 10 * math.log(a[0] / 1001 + a[1] / 4)
    assert p(w[3]) >= max(p((e, x, 1 - e - x)) for e in (0.001, 0.01) for x in np.linspace(0.01, 0.98, 50)) - 1e-3


def near_brute(texts, n, percent):
    sets = {}
    for d, t in texts.items():
        w = [x.lower() for x in words(t)]
        sets[d] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}
    ids = list(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(ids, edges)


@pytest.mark.parametrize("n, percent, block", [(3, 85, 2048), (5, 80, 4)])
def test_minhash(docs, texts, n, percent, block):
    sets, want = near_brute(texts, n, percent)
    got = {r["doc_id"]: r for r in minhash_dedup.near_duplicates(docs, shingle=n, percent=percent, block=block).collect()}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(s), want[d], want[d] == d) for d, s in sets.items()}


def test_minhash_of_groups_without_a_centre(spark):
    """Chains of copies, each like its neighbours only, and repeated rows."""
    rng, rows = random.Random(2), []
    w = [f"w{k}" for k in range(400)]
    for k in range(60):
        rows.append((k, " ".join(w)))
        for _ in range(8):
            w[rng.randrange(400)] = f"x{k}{rng.randrange(1000)}"
    rows += [rows[0], (None, " ".join(w)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, want = near_brute(dict(rows[:60]), 3, 85)
    got = minhash_dedup.near_duplicates(docs, shingle=3, percent=85, block=7).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    kept = minhash_dedup.keep_first(docs.selectExpr("*", "doc_id AS key", "1 AS kept"), shingle=3, percent=85)
    assert kept.columns == ["doc_id", "text", "key", "kept"]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect() if r["doc_id"] is not None) == sorted([(False, k) for k in set(want.values())] + [(False, 0)])


def test_minhash_estimate_and_empty(empty):
    rng = np.random.default_rng(0)
    for share in (0.3, 0.7, 0.9):
        both, a, b = rng.integers(0, 2**63, int(3000 * share)), rng.integers(0, 2**63, int(1500 * (1 - share))), rng.integers(0, 2**63, int(1500 * (1 - share)))
        x, y = (np.frombuffer(minhash_dedup.signature(minhash_dedup.minima(np.unique(np.r_[both, z]).astype(np.uint64))), np.uint8)[None] for z in (a, b))
        want = len(both) / (len(both) + len(a) + len(b))
        assert abs(float(minhash_dedup.estimate(x, y)[0, 0]) - want) < 4 * math.sqrt(want * (1 - want) / 128)
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.keep_first(empty).count() == 0


def test_quality(spark, docs, empty, texts):
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 1, 0), (41, None, 1), (42, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    ratio = quality.ratios(docs, labels)
    assert len(ratio) == quality.BUCKETS and ratio == quality.ratios(docs.repartition(7), labels)
    rows = {r["doc_id"]: r for r in quality.judge(docs, ratio).collect()}
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for d, t in texts.items():
        t = t or ""
        w = word.findall(t)
        times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        again = {j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if word.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, d
        assert r["base_failed"] == (len(w) < 10 or 100 * len(again) > 20 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert rows[100]["score"] == 0.0 and not rows[101]["kept"] and rows[0]["kept"]
    assert quality.judge(empty, ratio).count() == 0 and set(quality.ratios(empty, labels)) == {0.0}
    plan = quality.judge(docs, ratio)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sentencepiece(docs, empty, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = {r["doc_id"]: r for r in sentencepiece_bpe.encode(docs, PIECES).collect()}
    digests = {r["doc_id"]: r for r in sentencepiece_bpe.encode(docs, PIECES, digests=True).collect()}
    for d, t in texts.items():
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        raw = np.array(ids, "<u4").tobytes()
        assert bytes(rows[d]["ids"]) == raw and rows[d]["n_tokens"] == len(ids) and rows[d]["decoded"] == library.decode(ids)
        assert digests[d]["ids_sha256"] == hashlib.sha256(raw).hexdigest() and digests[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.encode(empty, PIECES).count() == 0


def test_sentencepiece_on_random_text():
    e = sentencepiece_bpe.PrefixTableEncoder(PIECES)
    rng = random.Random(3)
    for _ in range(1500):
        t = "".join(rng.choice("abcer  \n\té▁x日0.,()\r;'\"{}") for _ in range(rng.randrange(60)))
        assert np.frombuffer(e.encode(t), "<u4").tolist() == e.library.encode(t, add_bos=True, add_eos=True), repr(t)


@pytest.mark.parametrize("crowd", [1, line_dedup.CROWD])
def test_line_dedup(docs, empty, texts, crowd, monkeypatch):
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    sets, inverted, want = [], defaultdict(list), {}
    for d in sorted(texts):
        kept, n, gone = [], 0, 0
        for x in (texts[d] or "").split("\n"):
            w = frozenset(re.findall(r"[^\x20\x09-\x0D]+", x.lower()))
            if not w:
                kept.append(x)
                continue
            n += 1
            both = Counter(j for t in w for j in inverted[t])
            if any(100 * c >= 80 * (len(w) + len(sets[j]) - c) for j, c in both.items()):
                gone += 1
            else:
                kept.append(x)
            for t in w:
                inverted[t].append(len(sets))
            sets.append(w)
        want[d] = (n, gone, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_sha256"]) for r in line_dedup.digests(docs).collect()}
    assert got == want and sum(g for _, g, _ in want.values()) > 15
    kept = line_dedup.remove(docs)
    assert kept.columns == docs.columns and {r["doc_id"]: r["text"] for r in kept.collect() if r["doc_id"] in (0, 101)} == {0: texts[0], 101: None}
    assert line_dedup.remove(empty).count() == 0
    assert not re.search("Python|Pandas|Arrow", line_dedup.digests(docs)._jdf.queryExecution().executedPlan().toString())


def test_embedding_dedup(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 16))
    rows = []
    for k in range(240):
        x = centre[k % 6] + rng.normal(size=16) * (0.05 if k % 3 else 0.3)
        rows.append((k, [float(np.float32(v)) for v in x], k % 2))
    rows += [(240, rows[0][1], 0), (241, rows[0][1], 0), (242, rows[0][1], 1), (243, [0.0] * 16, 0), (244, None, 0), (245, [float("nan")] * 16, 0), (246, [None] * 16, 0), (247, rows[0][1], None), (248, [], 0), (249, [1.0, 2.0], 0), (250, [2.0, 4.0], 0), (251, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS tile", "2 AS rep")
    ok = [(i, np.array(x, np.float32).astype(float), c) for i, x, c in rows if c is not None and x and all(v is not None and math.isfinite(v) for v in x) and any(x)]
    edges = [(a, b) for k, (a, x, c) in enumerate(ok) for b, y, e in ok[:k] if c == e and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98]
    degree, comp = Counter(v for e in edges for v in e), components([r[0] for r in rows], edges)
    for tile in (16, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.link(df, tile=tile).collect()}
        assert got == {i: (degree[i], comp[i], comp[i] == i) for i, *_ in rows}
    assert len(edges) > 100 and embedding_dedup.link(df.limit(0)).count() == 0


def test_embedding_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(200, 24)), rng.normal(size=(150, 24)) * np.exp(rng.normal(size=(150, 24)))
    x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    cosine = x @ y.T
    for t in (0.1, 0.4, 0.6):
        assert embedding_dedup.possible(embedding_dedup.quantise(x), embedding_dedup.quantise(y), t)[cosine >= t].all()


def removed_brute(texts, n):
    first, out = {}, {}
    for d in sorted(texts):
        w = words(texts[d])
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), (d, k))
    for d in texts:
        w = words(texts[d])
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < (d, k):
                gone[k : k + n] = [True] * n
        out[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    return out


@pytest.mark.parametrize("chunks, fan", [(1, 256), (9, 256), (9, 3), (7, 2)])
def test_substring_dedup(docs, empty, texts, chunks, fan, monkeypatch):
    monkeypatch.setattr(substring_dedup, "chunk_count", lambda d: chunks)
    monkeypatch.setattr(exchange, "FAN", fan)
    want = removed_brute(texts, 20)
    got = {r["doc_id"]: r for r in substring_dedup.digests(docs).collect()}
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == {d: (len(words(t)), len(words(t)) - len(want[d]), hashlib.sha256(b" ".join(want[d])).hexdigest()) for d, t in texts.items()}
    kept = substring_dedup.remove(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    for r in kept.collect():
        d = r["doc_id"]
        assert r["text"] == (texts[d] if len(want[d]) == len(words(texts[d])) else b" ".join(want[d]).decode())
    assert substring_dedup.digests(empty).count() == 0 and substring_dedup.remove(empty).count() == 0


def test_substring_factors():
    start, doc, ref = (np.array(x) for x in ([3, 4, 5, 6, 30, 31], [1, 1, 7, 7, 7, 7], [10, 11, 0, 1, 40, 42]))
    assert substring_dedup.parse(start, doc, ref, 20) == [(3, 21, 1, 10), (5, 21, 7, 0), (30, 20, 7, 40), (31, 20, 7, 42)]


def test_packing(docs, empty, texts):
    t = Tokenizer.from_file(BYTES)
    ids = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4") for d, x in texts.items()}
    rows = sorted(packing.pack(docs, BYTES).collect(), key=lambda r: (r["doc_id"], r["start"]))
    at = Counter()
    for r in rows:
        d = r["doc_id"]
        piece = ids[d][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at[d] and r["length"] == len(piece) > 0 and r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids[d])
        at[d] += r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    fill = Counter()
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024 and sorted(fill) == list(range(len(fill)))
    assert sum(1024 - n for n in fill.values() if n & (n - 1)) <= 1024 + packing.MOST_PADDING * len(fill)
    assert packing.pack(empty, BYTES).count() == 0


def test_packing_plan():
    rng = random.Random(6)
    histogram = Counter(rng.randrange(1, 64) for _ in range(500))
    histogram[60] += 800  # a third or more of one length
    slots, stream, n, more = packing.plan(histogram, 64)
    used, fill = Counter(), Counter()
    for v, lo, hi, seq, off in slots:
        used[v] += hi - lo
        for k in range(hi - lo):
            assert fill[seq + k] == off
            fill[seq + k] += v
    for v, lo, hi, _ in stream:
        used[v] += hi - lo
    assert used == histogram and len(fill) == n and all(64 - packing.MOST_PADDING <= f <= 64 for f in fill.values())
    assert more == -(-sum(v * (hi - lo) for v, lo, hi, _ in stream) // 64)


def test_levenshtein_trie():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    terms, rng = ["idiot", "scum", "worthless", "lowei*", "abc*"], random.Random(7)
    trie = toxicity.LevenshteinTrie(terms)
    tried = ["idiot", "idiott", "dumm", "scun", "scum", "wortless", "loweixyz", "lowexyz", "lowie", "abcd", "abd", "", "idito"]
    tried += ["".join(rng.choice("idotscumabwe") for _ in range(rng.randrange(3, 8))) for _ in range(4000)]
    for w in tried:
        whole = min((1 + distance(w, t) for t in terms if not t.endswith("*") and distance(w, t) <= (len(t) >= 5)), default=0)
        stems = [t[:-1] for t in terms if t.endswith("*")]
        start = min((3 + min(distance(w[:k], s) for k in range(len(w) + 1)) for s in stems if min(distance(w[:k], s) for k in range(len(w) + 1)) <= (len(s) >= 5)), default=0)
        assert trie.find(w) == (whole or start), w


def test_toxicity(spark, docs, empty):
    rng, rows, labels = random.Random(8), [], []
    plain = [f"w{a}{b}{c}" for a in "abcdefgh" for b in "aeiouy" for c in "lmnrstuvwz"]
    for k in range(600):
        text = [rng.choice(plain) for _ in range(60)]
        toxic = k % 5 == 0
        for _ in range(4 * toxic):
            text[rng.randrange(60)] = rng.choice(["idiot", "pathetic", "idoit" if k > 500 else "idiot", "loweiung", "loweiheit"])
        rows.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    data = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(data, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(data, model).collect()}
    assert all(r["held_out"] == (crc(d, 3) == 1) and r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert all(got[d]["predicted"] == y for d, y in labels if crc(d, 3) == 1)
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert odd[100] == odd[101] < 0.3
    assert model.score('wa "you idiot" he said') < model.score("wa you idiot he wa")
    assert model.score("you are an idiiot and so patetic an idiat") > 0.7
    kept = toxicity.keep_clean(data.selectExpr("*", "1 AS score"), model)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == sum(r["predicted"] == 0 for r in got.values())
    assert toxicity.score(empty, model).count() == 0 and toxicity.fit(empty, spark.createDataFrame([], "doc_id long, toxic int")).score("x") == 0.0


def test_language_id(spark, docs, empty):
    rng = random.Random(9)
    kinds = {"aa": "the of and to in that is was for with", "bb": "der die das und ist nicht für mit sich auf", "cc": "el la de que y en los del las una"}
    rows = []
    for k in range(300):
        lang = list(kinds)[k % 3]
        rows.append((k, " ".join(rng.choice(kinds[lang].split()) for _ in range(rng.randrange(8, 80))), lang))
    rows += [(300, None, "aa"), (301, "123 ... !", "bb"), (302, "", "cc"), (303, "die und der nicht", None)]
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.fit(data)
    assert profiles.languages == ["aa", "bb", "cc"] and all(len(r) <= language_id.LENGTH for r in profiles.ranks)
    got = {r["doc_id"]: r for r in language_id.identify(data, profiles).collect()}
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows[:300] if crc(k, 5) == 0) and got[303]["lang_pred"] == "bb"
    assert [got[k]["lang_pred"] for k in (300, 301, 302)] == ["und"] * 3 and got[300]["score"] == 0.0
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (crc(d, 5) == 0) for d, r in got.items())
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}
    assert language_id.identify(empty, profiles).count() == 0


def test_pipeline(spark, docs, texts, tmp_path):
    import corpus_pipeline

    base = docs.select("doc_id", "text", "lang", "source", "n_chars")
    base.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert now.dtypes == base.dtypes, name
    assert {r["doc_id"] for r in now.collect()} <= set(texts) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in now.collect())
    stages = [n for n, _ in corpus_pipeline.STAGES]
    assert stages == ["toxicity", "line dedup", "MinHash near-dedup", "substring dedup", "packing"]
    assert SCHEMA and corpus_pipeline.run(spark, str(tmp_path)).count() > 50


def rank_brute(text, length=language_id.LENGTH):
    """A text's n-grams of one to four characters by frequency: runs of letters with one blank at each end."""
    spaced = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())).strip() + " "
    counts = Counter()
    for n in (1, 2, 3, 4):
        for k in range(len(spaced) - n + 1):
            g = spaced[k : k + n]
            if g != " " and " " not in g[1:-1]:
                counts[g] += 1
    return counts


def packed(gram):
    """The n-gram as the operator's integer, which breaks ties of frequency."""
    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        return x ^ x >> 31

    x = 0
    for k, c in enumerate(gram):
        code = 0 if c == " " else ord(c)
        x = mixed((mixed(x) + code) % (1 << 64)) if k == 3 else (x << 21) + code
    return x ^ len(gram) << 60


def test_language_id_against_brute_force(spark):
    """Profiles, out-of-place distances and scores, on words that languages share in part."""
    rng = random.Random(21)
    stems = ["an", "der", "tion", "que", "sch", "el", "ou", "ing", "ß", "ñ", "th", "en"]
    lean = {"aa": [9, 1, 5, 1, 1, 2, 1, 9, 1, 1, 9, 3], "bb": [4, 9, 1, 1, 9, 2, 1, 2, 6, 1, 1, 9], "cc": [3, 1, 5, 9, 1, 9, 6, 1, 1, 6, 1, 4]}
    word = lambda lang: "".join(rng.choices(stems, lean[lang], k=rng.randrange(1, 4)))
    rows = [(k, " ".join(word(lang) for _ in range(rng.randrange(3, 40))) + rng.choice(["", " 12, 3!", " -- "]), lang) for k in range(150) for lang in [list(lean)[k % 3]]]
    profiles = {}
    for lang in lean:
        counts = sum((rank_brute(t) for k, t, x in rows if x == lang and crc(k, 5) != 0), Counter())
        profiles[lang] = {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], packed(g)))[: language_id.LENGTH])}
    data = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language_id.fit(data)
    got = {r["doc_id"]: r for r in language_id.identify(data, fitted).collect()}
    for k, text, _ in rows:
        counts = rank_brute(text)
        own = sorted(counts, key=lambda g: (-counts[g], packed(g)))[: language_id.LENGTH]
        away = {x: sum(abs(p[g] - r) if g in p else language_id.LENGTH for r, g in enumerate(own)) for x, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        near = min(v for x, v in away.items() if x != best)
        assert got[k]["lang_pred"] == best and got[k]["score"] == pytest.approx(0.5 * (1 - away[best] / (language_id.LENGTH * len(own))) + 0.5 * (near - away[best]) / max(1, near)), k


@pytest.mark.parametrize("chunks, fan", [(1, 256), (9, 256), (9, 3), (7, 2)])
def test_lm_score_against_brute_force(docs, texts, chunks, fan, monkeypatch):
    """The interpolated probability of every text from counts of the whole training part and the weights that EM finds, by one level of messages and by several."""
    monkeypatch.setattr(lm_scoring, "chunk_count", lambda d: chunks)
    monkeypatch.setattr(exchange, "FAN", fan)
    tokens = {d: [w.lower() for w in words(t)] + [None] for d, t in texts.items()}

    def counted(ids):
        uni, bi, begins = Counter(), Counter(), 0
        for d in ids:
            begins += 1
            for a, b in zip(["begin", *tokens[d]], tokens[d], strict=False):
                uni[b] += 1
                bi[a, b] += 1
        return uni, bi, begins

    def parts(model, d):
        uni, bi, begins = model
        n = sum(uni.values())
        for a, b in zip(["begin", *tokens[d]], tokens[d], strict=False):
            context = begins if a == "begin" else uni[a]
            yield context.bit_length(), uni[b] / n, bi[a, b] / max(1, context)

    train = [d for d in texts if crc(d, 7) != 2]
    rest, deleted = counted([d for d in train if crc(d, 7) != 3]), [d for d in train if crc(d, 7) == 3]
    octave = lambda p: round(4 * math.log2(p)) if p else lm_scoring.NONE
    cells = Counter((c, octave(p), octave(q)) for d in deleted for c, p, q in parts(rest, d))

    def learned(chosen):
        w = [1 / 3] * 3
        for _ in range(60):
            total = [1e-3] * 3
            for (_, p, q), n in chosen.items():
                share = [w[0] / (len(rest[0]) + 1), w[1] * (0 if p == lm_scoring.NONE else 2 ** (p / 4)), w[2] * (0 if q == lm_scoring.NONE else 2 ** (q / 4))]
                total = [t + n * s / sum(share) for t, s in zip(total, share, strict=True)]
            w = [t / sum(total) for t in total]
        return w

    weights = {c: learned({k: n for k, n in cells.items() if k[0] == c}) for c in {k[0] for k in cells}}
    whole, any_ = counted(train), learned(cells)
    rows = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs).collect()}
    for d in texts:
        want = 0.0
        for c, p, q in parts(whole, d):
            w = weights.get(c, any_)
            want += math.log10(w[0] / (len(whole[0]) + 1) + w[1] * p + w[2] * q)
        assert rows[d] == pytest.approx(want, rel=1e-6), d


def test_quality_score_against_brute_force(spark, docs, texts):
    """Hashed counts, ratios, scores and verdicts; only the hash itself is Spark's."""
    labels = spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int")
    word = re.compile(r"[^\x20\x09-\x0D]+")
    vocabulary = sorted({w for t in texts.values() for w in word.findall(t or "")})
    pairs = sorted({p for t in texts.values() for w in [word.findall(t or "")] for p in zip(w, w[1:], strict=False)})
    from pyspark.sql import functions as F

    one = {r["w"]: (r["h"], r["b"]) for r in spark.createDataFrame([(w,) for w in vocabulary], "w string").select("w", F.xxhash64("w").alias("h")).withColumn("b", F.pmod("h", F.lit(quality.BUCKETS))).collect()}
    two = {(r["x"], r["y"]): r["b"] for r in spark.createDataFrame(pairs, "x string, y string").select("x", "y", F.pmod(F.xxhash64(F.xxhash64("x"), F.xxhash64("y")), F.lit(quality.BUCKETS)).alias("b")).collect()}
    buckets = {}
    for d, t in texts.items():
        w = word.findall(t or "")
        buckets[d] = [one[x][1] for x in w] + [two[p] for p in zip(w, w[1:], strict=False)]
    raw, target = Counter(b for bs in buckets.values() for b in bs), Counter(b for d in range(20) for b in buckets[d])
    s, n = quality.SMOOTHING, quality.BUCKETS
    ratio = [math.log((target[b] + s) / (sum(target.values()) + s * n)) - math.log((raw[b] + s) / (sum(raw.values()) + s * n)) for b in range(n)]
    assert quality.ratios(docs, labels) == pytest.approx(ratio)
    for r in quality.judge(docs, ratio).collect():
        bs = buckets[r["doc_id"]]
        want = sum(ratio[b] for b in bs) / len(bs) if bs else 0.0
        assert r["score"] == pytest.approx(want) and r["kept"] == (not r["base_failed"] and want >= quality.THRESHOLD)


def test_toxicity_score_against_brute_force():
    """Scores of a given model from edit distances of every word to every term."""
    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
        return row[-1]

    terms, weights = ["idiot", "scum", "worthless"], np.array([-2.0, 1.5, 0.3, 0.1, -0.7, 0.4, 0.2])
    model, rng = toxicity.Model(terms, weights), random.Random(22)
    pool = ["idiot", "idoit", "idiott,", "Scum!", "scun", "worthles", "you", "are", "the", "a", "calm", "word", "he", "said:", '"idiot"', "“", "fine.”", "Idiot"]
    for _ in range(300):
        ws = [rng.choice(pool) for _ in range(rng.randrange(0, 25))]
        hits, wrong, reported = 0.0, 0, 0
        for k, w in enumerate(ws):
            plain = w.strip(toxicity.STRIP).lower()
            edits = min((apart(plain, t) for t in terms if apart(plain, t) <= (len(t) >= 5)), default=None)
            if edits is None:
                continue
            before, after = ws[max(0, k - 4) : k + 1], ws[k : k + 5]
            opened, closed = any(x[0] in toxicity.QUOTES for x in before), any(x.rstrip(".,!?;:")[-1:] and x.rstrip(".,!?;:")[-1] in toxicity.QUOTES for x in after)
            if opened and closed or any(x.strip(toxicity.STRIP).lower() in toxicity.REPORTING for x in before[:-1]):
                reported += 1
            else:
                hits += 0.8 if edits else 1
                wrong += bool(edits)
        f = [1, math.log1p(hits), math.log1p(wrong), 0, math.log1p(reported), float(hits >= 2), min(1.0, 100 * hits / len(ws)) if ws else 0]
        assert model.score(" ".join(ws)) == pytest.approx(1 / (1 + math.exp(-float(weights @ f)))), ws
