"""Substring dedup by exact lookup of hashed windows, with factors in the manner of relative Lempel-Ziv.

The reference is the corpus itself, indexed in blocks: each block owns a range of hashed windows (20 words)
and knows the first place of every window.  A document asks all blocks about its windows, and the words that
windows with an earlier place cover go.  Factors are read off afterwards and only counted: a factor runs on for
as long as the following windows' first places lie next to each other.  No factor is extended against the
reference's text and none is the longest match: a window first seen elsewhere ends it.

Two rounds keep the exchange small: the first asks only whether a window's 64-bit hash is in another chunk,
the second sends a second hash and places for those that are.

Defined results: words are kept as they are; a null or empty text has no words and is kept; documents
shorter than a window lose nothing; rows that repeat a doc_id are at the same places, so neither takes words
from the other at the same start, and each loses only windows of its own; a null id comes before all others; extra columns survive where documents are returned.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Scratch, chunk_column, chunk_count, free_name, table, word_hashes
from .exchange import BASE, BASE2, Hops, Tokens, U, chunked, raw, window_hashes

WINDOW = 20
NULL_ID = -(1 << 63)
ASK = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("shared", pa.binary())])
SHARED = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("shared", pa.binary())])
PLACES = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("keys2", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])
#: Windows with an earlier place: document, start, hash, and the reference's document and start.
FOUND = pa.schema([("chunk", pa.int32()), ("doc", pa.binary()), ("start", pa.binary()), ("key", pa.binary()), ("ref_doc", pa.binary()), ("ref_start", pa.binary())])
#: First places of a sender's keys, in their order.
FIRSTS = pa.schema([("chunk", pa.int32()), ("shard", pa.int32()), ("ref_doc", pa.binary()), ("ref_start", pa.binary())])
SPANS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("n_factors", pa.int64())])


def sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long'}).get(str(f.type), str(f.type))}" for f in schema)


class Windows:
    def __init__(self, docs: pa.Table, n: int):
        self.tokens = Tokens(docs)
        self.key, self.doc, self.start = self.tokens.windows(n)
        self.distinct, self.at, self.times = np.unique(self.key, return_inverse=True, return_counts=True)
        self.ids = np.array([NULL_ID if d is None else d for d in self.tokens.doc_ids], np.int64)


def bits(b: bytes | None, size: int) -> np.ndarray:
    return np.zeros(size, bool) if b is None else np.unpackbits(np.frombuffer(b, np.uint8), count=size).astype(bool)


def asker(n: int, hops: Hops):
    def ask(docs: pa.Table) -> pa.Table:
        keys, chunk = Windows(docs, n).distinct, docs.column("chunk")[0].as_py()
        parts = hops.deal(chunk, keys)
        return table({"chunk": [chunk] * len(parts), "shard": [s for s, _ in parts], "keys": [keys[p].astype("<u8").tobytes() for _, p in parts], "shared": [None] * len(parts)}, ASK)

    return ask


def shared_keys(asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of messages to a shard: distinct keys, whether several chunks are known to have them, where each entry's key is among them, and the messages' ends."""
    keys = [raw(b.as_py()) for b in asked.column("keys")]
    distinct, at, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    known = np.concatenate([bits(b.as_py(), len(k)) for b, k in zip(asked.column("shared"), keys, strict=True)])
    shared = times > 1
    shared[at[known]] = True
    return distinct, shared, at, np.cumsum([len(k) for k in keys])


def shared_merger(hops: Hops, level: int):
    def merge(asked: pa.Table) -> pa.Table:
        keys, shared, _, _ = shared_keys(asked)
        sender = asked.column("shard")[0].as_py()
        parts = hops.deal(sender, keys, level)
        return table({"chunk": [sender] * len(parts), "shard": [s for s, _ in parts], "keys": [keys[p].astype("<u8").tobytes() for _, p in parts], "shared": [np.packbits(shared[p]).tobytes() for _, p in parts]}, ASK)

    return merge


def replied_bits(replies: pa.Table, keys: np.ndarray, sender: int, hops: Hops, level: int) -> np.ndarray:
    """Of each of a sender's keys, whether another chunk has it."""
    out, parts = np.zeros(len(keys), bool), dict(hops.deal(sender, keys, level))
    for s, b in zip(replies.column("shard").to_pylist(), replies.column("shared").to_pylist(), strict=True):
        out[parts[s]] = bits(b, parts[s].stop - parts[s].start)
    return out


def shared_teller(hops: Hops, level: int):
    """One bit for each key asked about: whether another chunk has it."""

    def tell(asked: pa.Table, replies: pa.Table | None) -> pa.Table:
        keys, shared, at, ends = shared_keys(asked)
        if replies is not None:
            shared = replied_bits(replies, keys, asked.column("shard")[0].as_py(), hops, level + 1)
        parts = np.split(shared[at], ends[:-1])
        return table({"chunk": asked.column("chunk").to_pylist(), "shard": asked.column("shard").to_pylist(), "shared": [np.packbits(b).tobytes() for b in parts]}, SHARED)

    return tell


def first_of(order_by: tuple, same: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Sorts by order_by (last key first, as lexsort); returns the order and, for each entry in that order, where its group began."""
    order = np.lexsort(order_by)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in same:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def places(n: int, hops: Hops):
    """Second round: sends the places of shared windows, once for each distinct window, to the shards (shard >= 0); repeats inside the chunk are found at once (a shard below 0 for each chunk)."""

    def tell(docs: pa.Table, shared: pa.Table) -> pa.Table:
        rows = {c: [] for c in PLACES.names}

        def add(*values):
            for c, v in zip(PLACES.names, values, strict=True):
                rows[c].append(v)

        if docs.num_rows:
            chunk, w = docs.column("chunk")[0].as_py(), Windows(docs, n)
            elsewhere = replied_bits(shared, w.distinct, chunk, hops, 0)
            some = np.flatnonzero(elsewhere[w.at] | (w.times[w.at] > 1))
            if len(some):
                key, doc, start, away = w.key[some], w.ids[w.doc[some]], w.start[some], elsewhere[w.at[some]]
                key2 = w.tokens.windows(n, BASE2)[0][some]
                order, began = first_of((start, doc, key2, key), (key, key2))
                key, key2, doc, start, away = (x[order] for x in (key, key2, doc, start, away))
                later = (doc != doc[began]) | (start != start[began])
                if later.any():
                    add(chunk, -1 - chunk, key[later].astype("<u8").tobytes(), None, np.c_[doc, doc[began]][later].astype("<i8").tobytes(), np.c_[start, start[began]][later].astype("<i4").tobytes())
                first = (began == np.arange(len(began))) & away
                key, key2, doc, start = (x[first] for x in (key, key2, doc, start))
                for s, p in hops.deal(chunk, key):
                    add(chunk, s, key[p].astype("<u8").tobytes(), key2[p].astype("<u8").tobytes(), doc[p].astype("<i8").tobytes(), start[p].astype("<i4").tobytes())
        return table(rows, PLACES)

    return tell


class Places:
    """Messages of places to a shard, in order of window and place, with the first place of every window: the next level's replies, or the first of those told."""

    def __init__(self, told: dict, replies: pa.Table | None):
        key, key2 = (np.concatenate([raw(b) for b in told[c]]) for c in ("keys", "keys2"))
        doc, start = np.concatenate([raw(b, "<i8") for b in told["doc"]]), np.concatenate([raw(b, "<i4") for b in told["start"]])
        self.sizes = [len(b) // 8 for b in told["keys"]]
        self.order, began = first_of((start, doc, key2, key), (key, key2))
        self.key, self.key2, self.doc, self.start = (x[self.order] for x in (key, key2, doc, start))
        self.first = began == np.arange(len(began))
        self.ref_doc, self.ref_start = self.doc[began], self.start[began]
        if replies is not None:
            r = replies.sort_by("shard").to_pydict()
            ref_doc, ref_start = np.concatenate([raw(b, "<i8") for b in r["ref_doc"]]), np.concatenate([raw(b, "<i4") for b in r["ref_start"]])
            assert len(ref_doc) == self.first.sum(), "a shard's replies are not complete"
            window = np.cumsum(self.first) - 1
            self.ref_doc, self.ref_start = ref_doc[window], ref_start[window]


def place_merger(hops: Hops, level: int):
    def merge(told: pa.Table) -> pa.Table:
        p, sender, rows = Places(told.to_pydict(), None), told.column("shard")[0].as_py(), {c: [] for c in PLACES.names}
        key, key2, doc, start = (x[p.first] for x in (p.key, p.key2, p.doc, p.start))
        for s, part in hops.deal(sender, key, level):
            for c, v in zip(PLACES.names, (sender, s, *(x[part].tobytes() for x in (key, key2, doc, start))), strict=True):
                rows[c].append(v)
        return table(rows, PLACES)

    return merge


def tell_first(told: pa.Table, replies: pa.Table | None) -> pa.Table:
    """For each sender the first places of its windows, in the order in which it asked."""
    r = told.to_pydict()
    p = Places(r, replies)
    ref_doc, ref_start = np.empty_like(p.ref_doc), np.empty_like(p.ref_start)
    ref_doc[p.order], ref_start[p.order] = p.ref_doc, p.ref_start
    ends = np.cumsum(p.sizes)[:-1]
    return table({"chunk": r["chunk"], "shard": r["shard"], "ref_doc": [x.tobytes() for x in np.split(ref_doc, ends)], "ref_start": [x.tobytes() for x in np.split(ref_start, ends)]}, FIRSTS)


def find_first(told: pa.Table, replies: pa.Table | None) -> pa.Table:
    """For each chunk the windows that start earlier elsewhere, with the first place."""
    r = told.to_pydict()
    if r["shard"][0] < 0:
        pairs = [(np.frombuffer(d, "<i8").reshape(-1, 2), np.frombuffer(s, "<i4").reshape(-1, 2)) for d, s in zip(r["doc"], r["start"], strict=True)]
        return table({"chunk": r["chunk"], "doc": [d[:, 0].tobytes() for d, _ in pairs], "start": [s[:, 0].tobytes() for _, s in pairs], "key": r["keys"], "ref_doc": [d[:, 1].tobytes() for d, _ in pairs], "ref_start": [s[:, 1].tobytes() for _, s in pairs]}, FOUND)
    p = Places(r, replies)
    source = np.repeat(np.arange(len(r["chunk"])), p.sizes)[p.order]
    later = (p.doc != p.ref_doc) | (p.start != p.ref_start)
    rows = {c: [] for c in FOUND.names}
    by_source = np.argsort(source[later], kind="stable")
    parts = [x[later][by_source] for x in (source, p.doc, p.start, p.key, p.ref_doc, p.ref_start)]
    edges = np.searchsorted(parts[0], np.arange(len(r["chunk"]) + 1))
    for k, chunk in enumerate(r["chunk"]):
        lo, hi = edges[k], edges[k + 1]
        if lo < hi:
            for c, v in zip(FOUND.names, (chunk, *(x[lo:hi].tobytes() for x in parts[1:])), strict=True):
                rows[c].append(v)
    return table(rows, FOUND)


def parse(start: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, reference document, reference word) from a document's windows with an earlier place, by start."""
    if not len(start):
        return []
    runs = (np.diff(start) == 1) & (np.diff(ref_doc) == 0) & (np.diff(ref_start) == 1)
    first = np.r_[0, np.flatnonzero(~runs) + 1]
    last = np.r_[first[1:] - 1, len(start) - 1]
    return [(int(start[a]), int(start[b] - start[a]) + n, int(ref_doc[a]), int(ref_start[a])) for a, b in zip(first, last, strict=True)]


def spans_of(found: pa.Table) -> dict[int, tuple[np.ndarray, ...]]:
    """Windows with an earlier place by document, in order of start: start, the reference's document and start, hash."""
    r = found.to_pydict()
    if not any(r["doc"]):
        return {}
    doc, start, key, ref_doc, ref_start = (np.concatenate([*(raw(b, k) for b in r[c]), np.empty(0, k)]) for c, k in (("doc", "<i8"), ("start", "<i4"), ("key", "<u8"), ("ref_doc", "<i8"), ("ref_start", "<i4")))
    order, began = first_of((ref_start, ref_doc, key, start, doc), (doc, start, key))
    one = order[began == np.arange(len(began))]  # of two places the earlier
    doc, start, key, ref_doc, ref_start = (x[one] for x in (doc, start, key, ref_doc, ref_start))
    ids, at = np.unique(doc, return_index=True)
    # A place that the chunk found first may itself start earlier elsewhere: that place counts.
    places, nth = np.unique((np.searchsorted(ids, doc) << 32) + start, return_inverse=True)
    keys, of = np.unique(key, return_inverse=True)
    code = nth * len(keys) + of  # rows of one id may have several windows at a place
    k = np.searchsorted(ids, ref_doc)
    known = k < len(ids)
    known[known] = ids[k[known]] == ref_doc[known]
    place = (k << 32) + ref_start
    to = np.searchsorted(places, place)
    known &= to < len(places)
    known[known] = places[to[known]] == place[known]
    want = to * len(keys) + of
    to = np.searchsorted(code, want)
    known &= to < len(code)
    known[known] = code[to[known]] == want[known]
    ref_doc, ref_start = ref_doc.copy(), ref_start.copy()
    first_doc, first_start = ref_doc[to[known]], ref_start[to[known]]
    ref_doc[known], ref_start[known] = first_doc, first_start
    return {int(d): (start[a:b], ref_doc[a:b], ref_start[a:b], key[a:b]) for d, a, b in zip(ids, at, np.r_[at[1:], len(doc)], strict=True)}


def by_row(doc_ids: list[int | None], found: pa.Table, n: int):
    """A function from a row's id and words to its own windows with an earlier place."""
    spans = spans_of(found)
    rows = Counter(NULL_ID if d is None else d for d in doc_ids)

    def own(doc: int | None, words: list[bytes]) -> tuple[np.ndarray, ...] | None:
        doc = NULL_ID if doc is None else doc
        if doc not in spans:
            return None
        start, ref_doc, ref_start, key = spans[doc]
        if rows[doc] == 1:
            return start, ref_doc, ref_start
        # Windows found in other rows of the id do not count.
        hashes = window_hashes(word_hashes(words), n, BASE) if len(words) >= n else np.empty(0, U)
        mine = start < len(hashes)
        mine[mine] = hashes[start[mine]] == key[mine]
        return (start[mine], ref_doc[mine], ref_start[mine]) if mine.any() else None

    return own


def cover(words: list[bytes], spans: tuple[np.ndarray, ...] | None, n: int) -> tuple[list[bytes], int, int]:
    """Kept words, words removed and factors."""
    if spans is None:
        return words, 0, 0
    factors = parse(*spans, n)
    gone = np.zeros(len(words), bool)
    for a, size, _, _ in factors:
        gone[a : a + size] = True
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g], int(gone.sum()), len(factors)


def found_windows(docs: DataFrame, window: int, chunks: int, scratch: Scratch) -> DataFrame:
    """By chunk, the windows that also start earlier."""
    parts, hops = chunked(docs, chunks), Hops(chunks)
    asked = asked_by_chunk(parts, window, hops)
    shared = scratch.write(hops.ask(asked, lambda level: shared_merger(hops, level), lambda level: (sql(SHARED), shared_teller(hops, level)), scratch), "shared")
    told = parts.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(places(window, hops), sql(PLACES))
    # What a chunk found by itself goes on in groups of their own, one for each chunk.
    found = scratch.write(hops.ask(told, lambda level: place_merger(hops, level), lambda level: (sql(FIRSTS), tell_first) if level else (sql(FOUND), find_first), scratch), "found")
    scratch.drop(shared)
    return found


def asked_by_chunk(parts: DataFrame, window: int, hops: Hops) -> DataFrame:
    return parts.groupBy("chunk").applyInArrow(asker(window, hops), sql(ASK))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, n_factors) of every document."""
    scratch, chunks = Scratch(docs.sparkSession, "substring-dedup"), chunk_count(docs)
    found = found_windows(docs, window, chunks, scratch)

    def digest(d: pa.Table, f: pa.Table) -> pa.Table:
        own, rows = by_row(d.column("doc_id").to_pylist(), f, window), {c: [] for c in SPANS.names}
        for doc, text in zip(d.column("doc_id").to_pylist(), d.column("text"), strict=True):
            words = text.as_py().encode().split()
            kept, removed, factors = cover(words, own(doc, words), window)
            for c, v in zip(SPANS.names, (doc, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), factors), strict=True):
                rows[c].append(v)
        return table(rows, SPANS)

    return chunked(docs, chunks).groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(digest, sql(SPANS))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns; a text that lost words is its kept words joined by spaces, others stay as they are."""
    scratch, chunks = Scratch(docs.sparkSession, "substring-dedup"), chunk_count(docs)
    found = found_windows(docs, window, chunks, scratch)
    names, schema = docs.columns, docs.schema

    def cut(d: pa.Table, f: pa.Table) -> pa.Table:
        ids, texts = d.column("doc_id").to_pylist(), []
        own = by_row(ids, f, window)
        for doc, text in zip(ids, d.column("text").to_pylist(), strict=True):
            words = (text or "").encode().split()
            spans = own(doc, words)
            texts.append(text if spans is None else b" ".join(cover(words, spans, window)[0]).decode())
        return d.select(names).set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    chunk = free_name(names, "chunk")
    dealt = docs.withColumn(chunk, chunk_column("doc_id", chunks))
    return dealt.groupBy(chunk).cogroup(found.groupBy("chunk")).applyInArrow(cut, T.StructType(schema.fields))
