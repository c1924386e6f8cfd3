"""Packing of tokenised documents into fixed windows by non-negative least squares.

A document is its token ids and a closing id.  Whole windows are cut off first; what is left over has a
length below the window.  Combinations of two or three such lengths that fill a window exactly are the
columns of a least-squares problem with non-negative repeat counts against the histogram of lengths;
counts are rounded down, the residual lengths are packed greedily into nearly full windows, and what
still remains is laid end to end and cut at window ends, so that one window at most needs more padding.

Only the histogram (fewer entries than the window has tokens) reaches the driver.  The rank of a piece
among those of its length comes from counts by task, not from a sort.

Defined results: a null text is empty (its closing id alone); repeated rows are packed each; other
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Scratch, arrow_column, record_batch

CLOSING_ID = 0
#: A greedily packed window may lack so many tokens; beyond it pieces are cut instead.
MOST_PADDING = 8

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, tail binary, part int, k long"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("tail", pa.binary()), ("part", pa.int32()), ("k", pa.int64())])
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PACKED_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in PACKED.split(", ")])


#: Fixed value: the pattern by which the byte-level tokenizer cuts a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteTokenizer:
    """Ids of a byte-level BPE tokenizer file.

    Its vocabulary is loaded into a faster encoder of the same scheme.  Texts that hold special tokens, or runs
    so long that the encoder's pattern engine could give up, go through the tokenizers library itself.
    """

    LONG_RUN = re.compile(r"\s{1000}|\S{5000}")

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        sign = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(sign[c] for c in t): i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.fast = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit integers."""
        if any(s in text for s in self.special) or len(text) >= 1000 and self.LONG_RUN.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def batches_of(texts: list, chars: int = 400_000):
    """Ranges of texts that hold about so many characters."""
    lo = total = 0
    for k, t in enumerate(texts):
        total += len(t or "")
        if total >= chars:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def cut_pieces(docs: DataFrame, path: str, window: int) -> DataFrame:
    """Pieces of at most `window` tokens; k is a piece's place among those of its length in its task."""

    def run(batches):
        t, part = tokenizer(path), TaskContext.get().partitionId()
        seen: Counter = Counter()
        closing = np.array([CLOSING_ID], "<u4").tobytes()
        for b in batches:
            ids, texts = arrow_column(b, "doc_id"), arrow_column(b, "text")
            for lo, hi in batches_of(texts):
                rows: dict[str, list] = {f.name: [] for f in PIECES_ARROW}
                for doc, text in zip(ids[lo:hi], texts[lo:hi], strict=True):
                    x = t.encode(text or "") + closing
                    n = len(x) // 4
                    for start in range(0, n, window):
                        piece = x[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        for name, v in zip(rows, (doc, start, length, zlib.crc32(piece), n, piece if length < window else None, part, seen[length]), strict=True):
                            rows[name].append(v)
                        seen[length] += 1
                yield record_batch(rows, PIECES_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c >= 0, of present lengths that add up to the window; c = 0 is none."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    pairs = [(a, window - a, 0) for a in lengths[::-1] if a >= window - a and there[window - a]]
    triples = [(a, b, window - a - b) for a in lengths[::-1] for b in lengths[(lengths <= a) & (2 * lengths >= window - a) & (lengths < window - a)][::-1] if there[window - a - b]]
    return np.array(pairs + triples, np.int64).reshape(-1, 3)


def repeat_counts(histogram: np.ndarray, combos: np.ndarray, sweeps: int = 4) -> np.ndarray:
    """Non-negative least squares by coordinate descent: counts x of the combinations that come closest to the histogram."""
    left = histogram.astype(float).tolist()
    x = [0.0] * len(combos)
    rows = combos.tolist()
    for _ in range(sweeps):
        for k, (a, b, c) in enumerate(rows):
            uses = Counter(v for v in (a, b, c) if v)
            norm = sum(u * u for u in uses.values())
            step = max(-x[k], sum(u * left[v] for v, u in uses.items()) / norm)
            if step:
                x[k] += step
                for v, u in uses.items():
                    left[v] -= u * step
    return np.array(x)


def plan(histogram: dict[int, int], window: int) -> tuple[list[tuple], list[tuple], int, int]:
    """Where pieces go, by rank among those of their length.

    Returns slots (length, first rank, end rank, first sequence, offset), then stream parts
    (length, first rank, end rank, position in the stream), and how many sequences the slots and the stream fill.
    """
    left = np.zeros(window + 1, np.int64)
    for v, n in histogram.items():
        left[v] = n
    slots, ranks, sequences = [], Counter(), 0

    def place(lengths: list[int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for v in lengths:
            slots.append((v, ranks[v], ranks[v] + times, sequences, offset))
            ranks[v] += times
            left[v] -= times
            offset += v
        sequences += times

    combos = combinations(np.flatnonzero(left), window)
    x = repeat_counts(left, combos)
    for k in np.argsort(-x, kind="stable"):
        lengths = [int(v) for v in combos[k] if v]
        times = min(int(x[k]), *(int(left[v]) // u for v, u in Counter(lengths).items()))
        if times > 0:
            place(lengths, times)
    skipped = np.zeros(window + 1, bool)
    while len(there := np.flatnonzero((left > 0) & ~skipped)):
        lengths, room, free = [], window, left.copy()
        v = int(there[-1])
        while True:
            lengths.append(v)
            free[v] -= 1
            room -= v
            fits = np.flatnonzero(free[: room + 1] > 0)
            if not len(fits):
                break
            v = int(fits[-1])
        if room > MOST_PADDING:
            skipped[lengths[0]] = True
        else:
            place(lengths, min(int(left[v]) // u for v, u in Counter(lengths).items()))
    stream, at = [], 0
    for v in np.flatnonzero(left).tolist():
        n = int(left[v])
        stream.append((v, ranks[v], ranks[v] + n, at))
        at += n * v
    return slots, stream, sequences, -(-at // window)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024) -> DataFrame:
    """Packs (doc_id, text): one row for each piece, with its sequence and its offset there."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.write(cut_pieces(docs, tokenizer_path, window), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = scratch.write(counts.withColumn("before", F.coalesce(before, F.lit(0).cast("long"))), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(window, 0)
    slots, stream, filled, _ = plan(histogram, window)
    slots = np.array([(v, lo, hi, whole + seq, off) for v, lo, hi, seq, off in slots], np.int64).reshape(-1, 5)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    stream_of = {v: (lo, at) for v, lo, _, at in stream}
    first_of = {int(v): int(np.searchsorted(slots[:, 0], v)) for v in np.unique(slots[:, 0])}
    shared = spark.sparkContext.broadcast((slots, first_of, stream_of, whole + filled))

    def run(batches):
        slots, first_of, stream_of, base = shared.value
        ends = {v: slots[slots[:, 0] == v] for v in first_of}
        for b in batches:
            cols = {f: arrow_column(b, f) for f in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail", "rank")}
            rows: list[tuple] = []
            for doc, start, length, crc, tokens, tail, rank in zip(*cols.values(), strict=True):
                if length == window:
                    rows.append((doc, start, length, crc, tokens, rank, 0))
                    continue
                lo, at = stream_of.get(length, (None, 0))
                if lo is None or rank < lo:
                    own = ends[length]
                    s = own[np.searchsorted(own[:, 1], rank, "right") - 1]
                    rows.append((doc, start, length, crc, tokens, int(s[3]) + rank - int(s[1]), int(s[4])))
                    continue
                at += (rank - lo) * length
                done = 0
                while done < length:
                    n = min(length - done, window - (at + done) % window)
                    rows.append((doc, start + done, n, zlib.crc32(tail[4 * done : 4 * (done + n)]), tokens, base + (at + done) // window, (at + done) % window))
                    done += n
            yield record_batch(dict(zip(PACKED_ARROW.names, zip(*rows, strict=True) if rows else [[]] * 7, strict=True)), PACKED_ARROW)

    ranked = pieces.join(counts.select("length", "part", "before"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("k"))
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "tail", "rank").mapInArrow(run, PACKED)
