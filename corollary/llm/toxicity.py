"""Toxicity scores from a lexicon that tolerates misspelling.

The lexicon is learned from a bounded sample of labelled rows: whole words, and beginnings of words,
that toxic rows hold and clean rows hardly do.  Its trie is intersected with Levenshtein automata of one
edit; the intersection is made deterministic as words are read and each state's moves are kept.  A window
of words around each hit tells quotation or report from abuse.  A logistic model over the hits gives the score.

Defined results: null and empty texts have no hits and get the model's score for that; repeated rows get
the same score; other columns are ignored; null labels teach nothing; of several labels for one id the
highest holds; without labels of both kinds every score is 0.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, bucket_column, bucket_of, record_batch, word_hashes

#: Labelled rows of each kind that teach the model, at most; they are those of the smallest hash of the id.
SAMPLE = {1: 2000, 0: 4000}
LONGEST = 20_000  # characters of a text that teaches, so that what the driver holds is bounded; longer ones teach nothing
FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
LEXICON = 400  # terms at most
SHORTEST_FUZZY = 5  # shorter terms must be spelled right
WINDOW = 4  # words on either side of a hit
MOST_STATES, MOST_MOVES = 200_000, 2_000_000  # that an automaton keeps
#: Words that report what another said, in English, German, Spanish and French.
REPORTING = frozenset(
    "said says wrote writes called quote quoted quoting word term so-called".split()
    + "sagte sagt schrieb schreibt nannte zitat zitierte zitiert wort begriff sogenannte".split()
    + "dijo dice escribió escribe llamó cita citó citando palabra término llamado".split()
    + "dit écrit écrivit appela citation cita citant mot terme soi-disant".split()
)
QUOTES = "\"'“”„«»‘’`"
STRIP = ".,!?;:()[]{}…-*_%#$&|<>" + QUOTES

SCORES = "doc_id long, held_out boolean, score double, predicted int"
SCORES_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


class LevenshteinTrie:
    """The intersection of a trie of terms and automata of at most one edit, as a lazily built deterministic automaton.

    Terms that end in '*' are beginnings of words.  `find` gives 0 for no match, 1 for a term, 2 for a
    misspelled term, 3 for a beginning and 4 for a misspelled beginning.
    """

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [0]  # bit 1: a term ends here; bit 2: a beginning does
        self.longest: list[int] = [0]
        for t in terms:
            node, stem = 0, t.rstrip("*")
            for ch in stem:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.ends.append(0)
                    self.longest.append(self.longest[node] + 1)
                node = nxt
            self.ends[node] |= 2 if t.endswith("*") else 1
        self.forget()

    def forget(self) -> None:
        """Drops all states and moves built so far."""
        self.moves: dict[tuple[int, str], int] = {}
        self.states: list[frozenset] = []
        self.codes: list[tuple[int, int]] = []
        self.index: dict[frozenset, int] = {}
        self.start = self.state({(0, 0, 0)})

    def state(self, items: set) -> int:
        """Items are (trie node, edits so far, code of a beginning already matched)."""
        todo, all_items = list(items), set(items)
        while todo:  # a term's letter left out of the word
            node, edits, code = todo.pop()
            if edits == 0:
                for nxt in self.children[node].values():
                    if (x := (nxt, 1, code)) not in all_items:
                        all_items.add(x)
                        todo.append(x)
        best: dict[tuple[int, int], int] = {}
        prefix = 0
        for node, edits, code in all_items:
            if node >= 0 and self.ends[node] & 2 and (edits == 0 or self.longest[node] >= SHORTEST_FUZZY):
                prefix = min(filter(None, (prefix, 3 + edits)))
            prefix = min(filter(None, (prefix, code)), default=0)
        for node, edits, _ in all_items:
            best[node, edits] = prefix
        if prefix:
            best[-1, 0] = prefix  # a matched beginning stays matched
        key = frozenset((n, e, c) for (n, e), c in best.items())
        if key not in self.index:
            self.index[key] = len(self.states)
            self.states.append(key)
            whole = min((1 + e for n, e, _ in key if n >= 0 and self.ends[n] & 1 and (e == 0 or self.longest[n] >= SHORTEST_FUZZY)), default=0)
            self.codes.append((whole, prefix))
        return self.index[key]

    def move(self, state: int, ch: str) -> int:
        to = set()
        for node, edits, code in self.states[state]:
            if node < 0:
                to.add((-1, 0, code))
                continue
            if (nxt := self.children[node].get(ch)) is not None:
                to.add((nxt, edits, code))
            if edits == 0:
                to.add((node, 1, code))  # a letter too many
                to.update((nxt, 1, code) for nxt in self.children[node].values())  # another letter
        return self.state(to) if to else -1

    def find(self, word: str) -> int:
        if len(self.states) > MOST_STATES or len(self.moves) > MOST_MOVES:
            self.forget()
        at, moves = self.start, self.moves
        for ch in word:
            key = (at, ch)
            nxt = moves.get(key)
            if nxt is None:
                nxt = moves[key] = self.move(at, ch)
            if nxt < 0:
                return 0
            at = nxt
        whole, prefix = self.codes[at]
        return whole or prefix


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    trie: LevenshteinTrie | None = None
    kept: dict[bytes, int] = field(default_factory=dict)

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "trie": None, "kept": {}}

    def codes(self, words: list[bytes]) -> list[int]:
        if self.trie is None:
            self.trie = LevenshteinTrie(self.terms)
        kept, out = self.kept, []
        try:
            return list(map(kept.__getitem__, words))
        except KeyError:
            pass
        if len(kept) > 400_000:
            kept.clear()
        for w in words:
            c = kept.get(w)
            if c is None:
                c = kept[w] = self.trie.find(normal(w.decode("utf-8", "replace")))
            out.append(c)
        return out

    def features(self, text: str) -> np.ndarray:
        """Hits in all (misspelled ones count a little less), the misspelled by kind, those in quotation or report, and their share of the words."""
        f = np.zeros(5)
        words = text.encode().split()
        codes = self.codes(words)
        if any(codes):
            for k, c in enumerate(codes):
                if c:
                    f[4 if quoted(words, k) else c - 1] += 1
        hits = f[0] + 0.8 * f[1] + f[2] + 0.6 * f[3]
        share = min(1.0, 100 * hits / len(words)) if words else 0.0
        return np.array([np.log1p(hits), np.log1p(f[1]), np.log1p(f[3]), np.log1p(f[4]), float(hits >= 2), share])

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        z = float(self.weights[0] + self.weights[1:] @ self.features(text or ""))
        return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


def normal(word: str) -> str:
    return word.strip(STRIP).lower()


def quoted(words: list[bytes], k: int) -> bool:
    """Whether a quotation mark opens before the hit and closes after it in the window, or a word of reporting stands before it."""
    before = [w.decode("utf-8", "replace") for w in words[max(0, k - WINDOW) : k + 1]]
    after = [w.decode("utf-8", "replace") for w in words[k : k + WINDOW + 1]]
    opened = any(w[0] in QUOTES for w in before)
    closed = any(w.rstrip(".,!?;:")[-1:] in tuple(QUOTES) for w in after)
    return (opened and closed) or any(normal(w) in REPORTING for w in before[:-1])


def term_candidates(text: str) -> set[str]:
    out = set()
    for w in {normal(x) for x in text.split()}:
        if w.isalpha() and len(w) >= 3:
            out.add(w)
            out.update(f"{w[:n]}*" for n in range(4, min(len(w), 9)))
    return out


def once_each(texts: list[str]) -> list[str]:
    """Of copies and near copies, which share the three smallest hashes of their words, one only."""
    out = {}
    for x in texts:
        words = set(x.lower().encode().split())
        out.setdefault(tuple(sorted(word_hashes(list(words)).tolist())[:3]), x)
    return list(out.values())


def lexicon(toxic: list[str], clean: list[str]) -> list[str]:
    """Terms of toxic and next to no clean texts, chosen until each toxic text that can be has three.

    The next term is the one in most texts that lack some; of terms in about the same texts the longest.
    Terms are made anew for each text as it is read, so that only counts are held.
    """
    found = once_each(toxic)
    seen: Counter = Counter()
    for x in found:
        seen.update(term_candidates(x))
    least = max(3, 0.005 * len(found))
    seen = Counter({t: n for t, n in seen.items() if n >= least})
    other: Counter = Counter()
    for x in once_each(clean):
        other.update(t for t in term_candidates(x) if t in seen)
    total = len(clean) + 1
    good = {t for t, n in seen.items() if (n / len(found)) / ((other[t] + 0.5) / total) >= 20}
    texts: dict[str, set[int]] = {t: set() for t in good}
    for k, x in enumerate(found):
        for t in term_candidates(x):
            if t in texts:
                texts[t].add(k)
    lacks = dict.fromkeys(range(len(found)), 3)
    chosen: list[str] = []
    while len(chosen) < LEXICON:
        gain = {t: sum(lacks[k] > 0 for k in ks) for t, ks in texts.items()}
        top = max(gain.values(), default=0)
        if top < least:
            break
        best = max((t for t, n in gain.items() if n >= 0.95 * top), key=lambda t: (len(t.rstrip("*")), gain[t], t))
        chosen.append(best)
        for k in texts[best]:
            lacks[k] -= 1
        stem = best.rstrip("*")
        texts = {t: ks for t, ks in texts.items() if not (t.rstrip("*").startswith(stem) or (t.endswith("*") and stem.startswith(t[:-1])))}
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30) -> np.ndarray:
    """Weights (intercept first) by Newton's method, with a penalty on all but the intercept."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge * 10)
    pen[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + pen * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learns from a bounded sample of the labelled rows outside the held-out fold."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(bucket_column("doc_id", FOLDS) != HELD_OUT)
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for kind, most in SAMPLE.items():
        some = rows.filter(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    ids = docs.sparkSession.createDataFrame(chosen.collect(), "doc_id long, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    texts = texts.filter(F.coalesce(F.length("text"), F.lit(0)) <= LONGEST).collect()
    toxic = [r["text"] or "" for r in texts if r["toxic"] == 1]
    clean = [r["text"] or "" for r in texts if r["toxic"] != 1]
    if not toxic or not clean:
        return Model()
    m = Model(lexicon(toxic, clean))
    x = np.array([m.features(t) for t in toxic + clean])
    m.weights = logistic(x, np.r_[np.ones(len(toxic)), np.zeros(len(clean))])
    return m


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            ids, texts = arrow_column(b, "doc_id"), arrow_column(b, "text")
            s = [m.score(t) for t in texts]
            yield record_batch({"doc_id": ids, "held_out": [bucket_of(d, FOLDS) == HELD_OUT for d in ids], "score": s, "predicted": [int(v >= THRESHOLD) for v in s]}, SCORES_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.schema

    def run(batches):
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) < threshold for t in arrow_column(b, "text")], pa.bool_()))

    return docs.mapInArrow(run, schema)


