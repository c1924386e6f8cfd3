"""Deleted interpolation: bigram, unigram and uniform estimates mixed by how often the context was seen.

Counts come from all training documents.  One fold of them is deleted to learn the weights: with counts of
the rest, expectation-maximisation finds for every bucket of context frequency (powers of two) the mixture
that makes the deleted tokens likeliest.  Those enter as counts of cells (bucket, quarter-octave of the
unigram estimate, of the bigram estimate), a table whose size does not grow with the corpus.

Counts are merged in shards and answered by chunk (see exchange.py); no vocabulary reaches one machine.

Defined results: a null or empty text is its end token alone; ids that are null count as the text 'null'
in the fold; repeated rows count and are scored each; other columns are ignored; with no training text
every known count is 0 and only the uniform estimate remains.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bucket_of, chunk_count, mix, table
from .exchange import BASE, Hops, Tokens, U, chunked, raw, squeeze, unsqueeze

FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Keys of the end token and of the beginning; words hold no space.
END, BEGIN = (U(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" begin"))
UNIGRAM, BIGRAM, TOTALS = 0, 1, 2
NONE = -9999  # the cell of an estimate of zero

ASK = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("deleted", pa.binary())])
ASK_SQL = "chunk int, shard int, kind int, keys binary, counts binary, deleted binary"
ANSWER = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("kind", pa.int32()), ("counts", pa.binary()), ("deleted", pa.binary()), ("n", pa.int64()), ("v", pa.int64()), ("n_rest", pa.int64()), ("v_rest", pa.int64())])
ANSWER_SQL = "chunk int, shard int, kind int, counts binary, deleted binary, n long, v long, n_rest long, v_rest long"
CELLS = pa.schema([("bucket", pa.int32()), ("p1", pa.int32()), ("p2", pa.int32()), ("n", pa.int64())])
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Grams:
    """A chunk's tokens with their distinct unigram and bigram keys."""

    def __init__(self, docs: pa.Table):
        t = Tokens(docs, lower=True)
        ends = t.starts + t.sizes
        self.doc_ids, self.sizes = t.doc_ids, t.sizes + 1
        self.token = np.insert(t.hashes, ends, END)
        self.firsts = np.r_[0, np.cumsum(self.sizes)][:-1].astype(np.int64)
        before = np.r_[BEGIN, self.token[:-1]] if len(self.token) else self.token
        before[self.firsts] = BEGIN
        fold = np.array([bucket_of(d, FOLDS) for d in t.doc_ids], np.int64)
        self.held_out = fold == HELD_OUT
        self.trains = np.repeat(~self.held_out, self.sizes)
        self.deleted = np.repeat(fold == DELETED, self.sizes)
        n_begin = [int((~self.held_out).sum()), int((fold == DELETED).sum())]
        self.unigrams, where = np.unique(np.r_[self.token, BEGIN], return_inverse=True)
        self.token_at, self.begin_at = where[:-1], int(where[-1])
        self.before_at = np.r_[self.begin_at, self.token_at[:-1]] if len(self.token) else self.token_at
        self.before_at[self.firsts] = self.begin_at
        with np.errstate(over="ignore"):
            self.bigrams, self.bigram_at = np.unique(mix(before * BASE + mix(self.token)), return_inverse=True)
        self.counts = {}
        for kind, keys, at in ((UNIGRAM, self.unigrams, self.token_at), (BIGRAM, self.bigrams, self.bigram_at)):
            self.counts[kind] = [np.bincount(at[m], minlength=len(keys)) for m in (self.trains, self.deleted)]
        for k in (0, 1):
            self.counts[UNIGRAM][k][self.begin_at] = n_begin[k]

    def answers(self, rows: pa.Table) -> tuple[np.ndarray, ...]:
        """Counts over the corpus: unigrams, deleted unigrams, bigrams, deleted bigrams."""
        out = [c for kind in (UNIGRAM, BIGRAM) for c in replied(rows, kind)]
        assert len(out[0]) == len(self.unigrams) and len(out[2]) == len(self.bigrams), "a chunk's answers are not complete"
        return tuple(out)


def replied(rows: pa.Table, kind: int) -> list[np.ndarray]:
    """Counts and deleted counts of a sender's keys of one kind, in the order of the keys."""
    r = rows.filter(pc.equal(rows.column("kind"), kind)).sort_by("shard").to_pydict()
    return [np.concatenate([*(unsqueeze(b) for b in r[name]), np.empty(0, np.int64)]) for name in ("counts", "deleted")]


def messages(sender: int, known: list[tuple[int, np.ndarray, list[np.ndarray]]], hops: Hops, level: int) -> pa.Table:
    """What a sender asks about its sorted keys, with its counts, by kind."""
    rows = {n: [] for n in ASK.names}
    for kind, keys, counts in known:
        for s, part in hops.deal(sender, keys, level):
            for n, v in zip(ASK.names, (sender, s, kind, keys[part].astype("<u8").tobytes(), *(squeeze(c[part]) for c in counts)), strict=True):
                rows[n].append(v)
    return table(rows, ASK)


def asker(hops: Hops):
    def ask(docs: pa.Table) -> pa.Table:
        g = Grams(docs)
        return messages(docs.column("chunk")[0].as_py(), [(UNIGRAM, g.unigrams, g.counts[UNIGRAM]), (BIGRAM, g.bigrams, g.counts[BIGRAM])], hops, 0)

    return ask


class Merged:
    """Messages of one kind to a shard: distinct keys, summed counts, and where each sender's keys are among them."""

    def __init__(self, asked: pa.Table, kind: int):
        some = asked.filter(pc.equal(asked.column("kind"), kind)).to_pydict()
        self.senders = some["chunk"]
        keys = [raw(b) for b in some["keys"]]
        self.distinct, at = np.unique(np.concatenate([*keys, np.empty(0, U)]), return_inverse=True)
        self.at = np.split(at, np.cumsum([len(k) for k in keys])[:-1]) if keys else []
        self.sums = []
        for name in ("counts", "deleted"):
            c = np.concatenate([*(unsqueeze(b) for b in some[name]), np.empty(0, np.int64)])
            self.sums.append(np.bincount(at, weights=c, minlength=len(self.distinct)).astype(np.int64))


def merger(hops: Hops, level: int):
    def merge(asked: pa.Table) -> pa.Table:
        kinds = [(kind, Merged(asked, kind)) for kind in (UNIGRAM, BIGRAM)]
        return messages(asked.column("shard")[0].as_py(), [(kind, m.distinct, m.sums) for kind, m in kinds], hops, level)

    return merge


def answer(asked: pa.Table, replies: pa.Table | None) -> pa.Table:
    """Counts for each sender, from the next level's replies or, where all senders have asked, from the sums; totals come from the latter alone and are handed on."""
    if not asked.num_rows:
        return replies
    rows = {n: [] for n in ANSWER.names}
    totals = [0, 0, 0, 0]
    shard = asked.column("shard")[0].as_py()
    for kind in (UNIGRAM, BIGRAM):
        m = Merged(asked, kind)
        sums = m.sums if replies is None else replied(replies, kind)
        assert len(sums[0]) == len(m.distinct), "a shard's replies are not complete"
        if kind == UNIGRAM and replies is None:
            words = m.distinct != BEGIN
            rest = sums[0] - sums[1]
            totals = [int(sums[0][words].sum()), int((sums[0][words] > 0).sum()), int(rest[words].sum()), int((rest[words] > 0).sum())]
        for chunk, own in zip(m.senders, m.at, strict=True):
            for n, v in zip(ANSWER.names, (chunk, shard, kind, squeeze(sums[0][own]), squeeze(sums[1][own]), None, None, None, None), strict=True):
                rows[n].append(v)
    if replies is None:
        for n, v in zip(ANSWER.names, (-1 - shard, shard, TOTALS, None, None, *totals), strict=True):
            rows[n].append(v)
    return table(rows, ANSWER)


def estimates(g: Grams, uni: np.ndarray, bi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every token: bucket of its context, unigram and bigram estimate."""
    context = uni[g.before_at]
    p1 = uni[g.token_at] / max(1, n)
    p2 = bi[g.bigram_at] / np.maximum(1, context)
    return np.where(context > 0, np.log2(np.maximum(1, context)).astype(np.int64) + 1, 0), p1, p2


def celler(n_rest: int):
    def cells(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table({n: [] for n in CELLS.names}, CELLS)
        g = Grams(docs)
        uni, uni_del, bi, bi_del = g.answers(answers)
        bucket, p1, p2 = (x[g.deleted] for x in estimates(g, uni - uni_del, bi - bi_del, n_rest))
        octaves = [np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300))), NONE).astype(np.int64) for p in (p1, p2)]
        code, n = np.unique((bucket << 32) + ((octaves[0] + 10000) << 16) + octaves[1] + 10000, return_counts=True)
        return table({"bucket": code >> 32, "p1": ((code >> 16) & 0xFFFF) - 10000, "p2": (code & 0xFFFF) - 10000, "n": n}, CELLS)

    return cells


def mixture(cells: list, v_rest: int, rounds: int = 60) -> dict[int, np.ndarray]:
    """Weights (uniform, unigram, bigram) of every bucket; key -1 is for buckets without deleted tokens."""
    a = np.array([[c["bucket"], c["p1"], c["p2"], c["n"]] for c in cells], float).reshape(-1, 4)
    p = np.c_[np.full(len(a), 1 / (v_rest + 1)), *(np.where(a[:, k] == NONE, 0.0, 2 ** (a[:, k] / 4)) for k in (1, 2))]

    def learn(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds if rows.any() else 0):
            share = p[rows] * w
            share /= share.sum(1, keepdims=True)
            w = (share * a[rows, 3:]).sum(0) + 1e-3
            w /= w.sum()
        return w

    return {-1: learn(np.ones(len(a), bool))} | {int(b): learn(a[:, 0] == b) for b in np.unique(a[:, 0])}


def scorer(n: int, v: int, weights: dict[int, np.ndarray]):
    def score(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return table({c: [] for c in SCORES.names}, SCORES)
        g = Grams(docs)
        uni, _, bi, _ = g.answers(answers)
        bucket, p1, p2 = estimates(g, uni, bi, n)
        w = np.array([weights.get(k, weights[-1]) for k in range(66)])[bucket]
        if not n:
            w = np.array([[1.0, 0.0, 0.0]])
        p = w[:, 0] / (v + 1) + w[:, 1] * p1 + w[:, 2] * p2
        c = uni[g.token_at]
        total = lambda x: np.add.reduceat(x, g.firsts)
        return table({
            "doc_id": g.doc_ids, "held_out": g.held_out, "n_tokens": g.sizes, "n_known": total((c > 0).astype(np.int64)), "train_tokens": np.full(len(g.sizes), n),
            "base_score": total(np.log10((c + 1) / (n + v + 1))), "score": total(np.log10(p)),
        }, SCORES)

    return score


def asked_by_chunk(chunks: DataFrame, hops: Hops) -> DataFrame:
    return chunks.groupBy("chunk").applyInArrow(asker(hops), ASK_SQL)


def score(docs: DataFrame) -> DataFrame:
    """Scores every document (doc_id, text) under the model that all but the held-out fold teach."""
    scratch = Scratch(docs.sparkSession, "lm-scoring")
    n = chunk_count(docs)
    chunks = chunked(docs, n)
    hops = Hops(n)
    answers = scratch.write(hops.ask(asked_by_chunk(chunks, hops), lambda level: merger(hops, level), lambda level: (ANSWER_SQL, answer), scratch), "answers")
    totals = answers.filter(F.col("kind") == TOTALS).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "n_rest", "v_rest"))).first()
    replies = answers.filter(F.col("kind") != TOTALS).select("chunk", "shard", "kind", "counts", "deleted")
    both = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    cells = scratch.write(both.applyInArrow(celler(totals["n_rest"]), "bucket int, p1 int, p2 int, n long").groupBy("bucket", "p1", "p2").agg(F.sum("n").alias("n")), "cells")
    weights = mixture(cells.collect(), totals["v_rest"])
    scratch.drop(cells)
    return both.applyInArrow(scorer(totals["n"], totals["v"], weights), SCORES_SQL)
