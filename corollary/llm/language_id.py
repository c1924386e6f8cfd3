"""Language identification by rank-order profiles.

A language's profile ranks its most frequent character n-grams (one to four letters of words with their
ends marked).  A document's own ranking is held against each profile: every n-gram counts by how far it
stands out of place, one that the profile lacks by the most.  The nearest profile names the language.

Defined results: `und` with score 0 for null texts, texts without a letter, and when there is nothing to
learn from; ties go to the smaller language code; repeated rows get the same answer; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, bucket_column, bucket_of, mix, record_batch

FOLDS, HELD_OUT = 5, 0
LENGTH = 300  # ranks in a profile
ORDERS = (1, 2, 3, 4)
#: Rows of each language that teach, at most; they are those of the smallest hash of the id.
SAMPLE = 1500
UNKNOWN = "und"

FOUND = "doc_id long, held_out boolean, lang_pred string, score double"
FOUND_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def letters(text: str) -> np.ndarray:
    """Lower-case code points; whatever is no letter is 0, and runs of it are one 0."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    ok = ((a >= 97) & (a <= 122)) | ((a >= 0xC0) & (a != 0xD7) & (a != 0xF7) & (a < 0x250))
    rest = a >= 0x250
    rest |= (a == 0xAA) | (a == 0xB5) | (a == 0xBA)
    if rest.any():
        kinds, where = np.unique(a[rest], return_inverse=True)
        ok[rest] = np.array([chr(c).isalpha() for c in kinds])[where]
    a = np.where(ok, a, 0).astype(np.uint64)
    a = np.r_[np.uint64(0), a, np.uint64(0)]
    return a[np.r_[True, (a[1:] != 0) | (a[:-1] != 0)]]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as integers with counts: 21 bits a character up to three, hashed with the fourth."""
    a = letters(text)
    out = []
    for n in ORDERS:
        g = np.zeros(max(0, len(a) - n + 1), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(n):
                x = a[k : k + len(g)]
                g = mix(mix(g) + x) if k == 3 else g * np.uint64(1 << 21) + x
        inner = a != 0 if n == 1 else np.ones(len(g), bool)
        for k in range(1, n - 1):
            inner &= a[k : k + len(g)] != 0
        out.append(g[inner] ^ np.uint64(n << 60))
    return np.unique(np.concatenate(out), return_counts=True)


def ranking(keys: np.ndarray, counts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The most frequent keys, most frequent first; equal counts in order of the key."""
    if len(keys) > 4 * length:
        least = np.partition(counts, len(counts) - length)[len(counts) - length]
        some = counts >= least
        keys, counts = keys[some], counts[some]
    return keys[np.lexsort((keys, -counts))[:length]]


@dataclass
class Profiles:
    languages: list[str]
    ranks: list[np.ndarray]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in order, and the rank of each in each profile (LENGTH where it is missing)."""
        keys = np.unique(np.concatenate(self.ranks)) if self.ranks else np.empty(0, np.uint64)
        where = np.full((len(self.languages), len(keys) + 1), LENGTH, np.int32)
        for k, r in enumerate(self.ranks):
            where[k, np.searchsorted(keys, r)] = np.arange(len(r))
        return keys, where


def predict(text: str | None, languages: list[str], keys: np.ndarray, where: np.ndarray) -> tuple[str, float]:
    g, n = grams(text) if text else (np.empty(0, np.uint64), np.empty(0, np.int64))
    own = ranking(g, n)
    if not len(own) or not languages:
        return UNKNOWN, 0.0
    at = np.searchsorted(keys, own)
    at[(at >= len(keys)) | (keys[np.minimum(at, len(keys) - 1)] != own)] = len(keys)
    found = where[:, at]
    out_of_place = np.where(found < LENGTH, np.abs(found - np.arange(len(own), dtype=np.int32)), LENGTH).sum(1)
    best = int(out_of_place.argmin())
    others = np.delete(out_of_place, best)
    most = LENGTH * len(own)
    # half for the nearness of the best, half for its lead over the next
    lead = (others.min() - out_of_place[best]) / max(1, others.min()) if len(others) else 1.0
    return languages[best], float(min(1.0, 0.5 * (1 - out_of_place[best] / most) + 0.5 * lead))


def fit(docs: DataFrame) -> Profiles:
    """Profiles from a bounded sample of each language's rows outside the held-out fold."""
    rows = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null").filter(bucket_column("doc_id", FOLDS) != HELD_OUT)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles([], [])
    # Each language keeps ids whose hash lies below a share that leaves about SAMPLE of them.
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, SAMPLE / n))).otherwise(share)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def count(batches):
        for b in batches:
            for lang, text in zip(arrow_column(b, "lang"), arrow_column(b, "text"), strict=True):
                g, n = grams(text)
                yield record_batch({"lang": [lang] * len(g), "g": g.view(np.int64), "n": n}, pa.schema([("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())]))

    found = rows.filter(place < share).select("lang", "text").mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    # Equal counts by key, which is unsigned: the lowest sign first.
    place = Window.partitionBy("lang").orderBy(F.desc("n"), F.col("g").bitwiseXOR(F.lit(-(1 << 63))))
    top = found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= LENGTH).collect()
    languages = sorted(counts)
    ranks = [[r["g"] for r in sorted((r for r in top if r["lang"] == lang), key=lambda r: r["rank"])] for lang in languages]
    return Profiles(languages, [np.array(r, np.int64).view(np.uint64) for r in ranks])


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast((profiles.languages, *profiles.table()))

    def run(batches):
        languages, keys, where = shared.value
        for b in batches:
            ids = arrow_column(b, "doc_id")
            found = [predict(t, languages, keys, where) for t in arrow_column(b, "text")]
            yield record_batch({"doc_id": ids, "held_out": [bucket_of(d, FOLDS) == HELD_OUT for d in ids], "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}, FOUND_ARROW)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
