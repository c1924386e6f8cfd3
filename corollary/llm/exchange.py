"""Whole-corpus facts about hashed keys, asked for and answered by chunk.

Documents are dealt to chunks by a hash of their id.  A chunk sends each of its distinct keys once to the
shard that owns the key's range, with what it knows about it; the shard merges what all chunks know and
answers every chunk in the order of its keys, so that an answer needs no keys.  A key that a third of all
rows hold is still one entry a chunk.

A sender deals its keys to at most FAN shards, so that messages stay large however many chunks there are.  More
chunks than that take several levels: a shard merges what a block of senders say about a range of keys and
asks on as one sender, by narrower ranges and larger blocks, until a shard hears all chunks about its range;
answers come back the same way.  Messages are FAN a sender and level, and levels grow with the log of the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, chunk_column, mix, word_hashes

U = np.uint64
#: Shards that one sender deals its keys to at most.
FAN = 256
BASE, BASE2 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


def chunked(docs: DataFrame, n: int) -> DataFrame:
    return docs.select(chunk_column("doc_id", n).alias("chunk"), "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))


class Tokens:
    """The words of a chunk's documents as hashes, end to end."""

    def __init__(self, table: pa.Table, *, lower: bool = False, keep_words: bool = False):
        self.doc_ids = table.column("doc_id").to_pylist()
        self.words, parts, sizes = [], [], []
        for text in table.column("text"):
            b = (text.as_py() or "").encode()
            w = (b.lower() if lower else b).split()
            sizes.append(len(w))
            parts.append(word_hashes(w))
            if keep_words:
                self.words.append(w)
        self.sizes = np.array(sizes, np.int64)
        self.hashes = np.concatenate([*parts, np.empty(0, U)])
        self.starts = np.r_[0, np.cumsum(self.sizes)][:-1].astype(np.int64)

    def windows(self, n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, document's place and start of every window of n words."""
        doc = np.repeat(np.arange(len(self.sizes)), np.maximum(self.sizes - n + 1, 0))
        if not len(doc):
            return np.empty(0, U), doc, doc
        firsts = np.r_[0, np.cumsum(np.maximum(self.sizes - n + 1, 0))][:-1]
        start = np.arange(len(doc)) - firsts[doc]
        at = self.starts[doc] + start
        return window_hashes(self.hashes, n, base)[at], doc, start


def window_hashes(h: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A polynomial hash of every n consecutive entries, from differences of prefix sums modulo 2**64."""
    inverse = U(pow(int(base), -1, 1 << 64))
    size = len(h)
    with np.errstate(over="ignore"):
        down = np.cumprod(np.full(size, inverse, U), dtype=U)  # base ** -(j + 1)
        up = np.cumprod(np.full(size, base, U), dtype=U)
        sums = np.r_[U(0), np.cumsum(mix(h ^ base) * down, dtype=U)]
        return mix((sums[n:] - sums[:-n]) * up[: size - n + 1])


def shard_bounds(keys: np.ndarray, shards: int, first: int = 0, of: int | None = None) -> np.ndarray:
    """Where each part of the sorted keys begins, and the end; the parts are `shards` of `of` equal ranges, from the range `first` on, and hold all keys."""
    edges = np.array([(k << 64) // (of or shards) for k in range(first + 1, first + shards)], dtype=U)
    return np.r_[0, np.searchsorted(keys, edges), len(keys)]


class Hops:
    """The levels by which chunks ask.

    Ranges of keys number radix ** (level + 1) at a level.  A shard is a block of radix ** (level + 1) chunks and a
    range, as block * ranges + range; it is the sender of the next level.
    """

    def __init__(self, chunks: int, fan: int | None = None):
        fan = fan or FAN
        self.levels = self.radix = 1
        while fan**self.levels < chunks:
            self.levels += 1
        while self.radix**self.levels < chunks:
            self.radix += 1

    def deal(self, sender: int, keys: np.ndarray, level: int = 0) -> list[tuple[int, slice]]:
        """The shards that a sender asks about its sorted keys, and their parts of the keys."""
        ranges = self.radix**level
        block, own = divmod(sender, ranges)
        first = own * self.radix
        at = shard_bounds(keys, self.radix, first, ranges * self.radix)
        shard = block // self.radix * ranges * self.radix + first
        return [(shard + k, slice(at[k], at[k + 1])) for k in np.flatnonzero(np.diff(at)).tolist()]

    def ask(self, asked: DataFrame, merge: Callable, reply: Callable, scratch: Scratch, level: int = 0) -> DataFrame:
        """Replies by sender (column chunk) to messages (chunk, shard, ...).

        merge(level) gives the function that makes a shard's messages into its own as a sender of that level; reply(level)
        gives a schema and the function that answers a shard's messages, from what the next level replied or, at the
        last level (None), from the messages alone.  A shard below 0 asks nobody else.
        """
        schema, answer = reply(level)
        if level == self.levels - 1:
            return asked.groupBy("shard").applyInArrow(lambda t: answer(t, None), schema)
        asked = scratch.write(asked, "asked")
        more = asked.filter("shard >= 0").groupBy("shard").applyInArrow(merge(level + 1), asked.schema)
        replies = self.ask(more, merge, reply, scratch, level + 1)
        return asked.groupBy("shard").cogroup(replies.groupBy("chunk")).applyInArrow(answer, schema)


def squeeze(a: np.ndarray) -> bytes:
    """Whole numbers, small ones cheap."""
    wide = bool(len(a)) and int(a.max()) >= 1 << 32
    return (b"8" if wide else b"4") + zlib.compress(a.astype("<u8" if wide else "<u4").tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), "<u8" if b[:1] == b"8" else "<u4").astype(np.int64)


def raw(b: bytes, kind: str = "<u8") -> np.ndarray:
    return np.frombuffer(b, kind)
