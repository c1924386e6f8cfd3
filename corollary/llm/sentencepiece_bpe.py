"""SentencePiece BPE by a prefix table.

For each prefix of a text there is one last token of its encoding.  Walking left to right, the tokens
that end at a position come from an automaton over the vocabulary; the one whose pairing with the last
token before it survives merging is the last token there.  Ids are then read off backwards.

Defined results: a null text is encoded as the empty text (begin and end ids only); repeated rows are
encoded each; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import arrow_column, record_batch

SPACE = "▁"
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Words whose ids a worker keeps, and pairs whose compatibility it keeps.
KEPT_WORDS, KEPT_PAIRS = 600_000, 500_000


class PrefixTableEncoder:
    """Encodes as the library does, for a BPE model with byte fallback and no text normalisation."""

    def __init__(self, model_file: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = self.library.get_piece_size()
        self.bos, self.eos, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.pieces: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        for i in range(n):
            p = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                self.pieces[p] = i
        self.score = {p: self.library.get_score(i) for p, i in self.pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for p in self.pieces:
            if len(p) > 1:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        # A cut before a space that follows something else is safe when no piece reaches over it.
        self.cut_at_space = not any(a != SPACE and b == SPACE for p in self.pieces for a, b in zip(p, p[1:], strict=False))
        lone = not any("\n" in p and len(p) > 1 for p in self.pieces)
        self.units = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if lone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """The merges that the model makes, best score first, then leftmost; used on pairs of tokens only."""
        parts = list(s)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                v = self.score.get(parts[k] + parts[k + 1])
                if v is not None and (best is None or v > best):
                    best, at = v, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        """Whether the two tokens side by side stay as they are."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self.merged(a + b) == [a, b]
        return found

    def tokens(self, s: str) -> list[str]:
        """Tokens of a unit of text through its prefix table; characters without a piece stand alone."""
        n = len(s)
        ending: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(s):
            ending[end].append(piece)
        last: list[str] = [""] * (n + 1)
        for j in range(1, n + 1):
            chosen = ""
            for piece in (*ending[j - 1], s[j - 1]):
                i = j - len(piece)
                if (i == 0 or self.compatible(last[i], piece)) and (len(piece) == 1 or self.merged_whole(piece)):
                    chosen = piece
                    break
            last[j] = chosen
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    @lru_cache(maxsize=65536)  # noqa: B019  one encoder a worker
    def merged_whole(self, piece: str) -> bool:
        """Whether merging ever makes this piece from its characters."""
        return self.merged(piece) == [piece]

    def unit_ids(self, s: str) -> bytes:
        ids: list[int] = []
        for t in self.tokens(s):
            i = self.pieces.get(t)
            if i is None:
                ids += [self.bytes[b] for b in t.encode()] if self.bytes else [self.unk]
            else:
                ids.append(i)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, with begin and end."""
        words, out = self.words, [np.array([self.bos], "<u4").tobytes()]
        if text:
            s = SPACE + text.replace(" ", SPACE)
            for w in self.units.findall(s) if self.cut_at_space else [s]:
                ids = words.get(w)
                if ids is None:
                    ids = self.unit_ids(w)
                    if len(w) < 64:
                        if len(words) >= KEPT_WORDS:
                            words.clear()
                        words[w] = ids
                out.append(ids)
        out.append(np.array([self.eos], "<u4").tobytes())
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def encoder(model_file: str) -> PrefixTableEncoder:
    return PrefixTableEncoder(model_file)


def encode(docs: DataFrame, model_file: str, *, digests: bool = False) -> DataFrame:
    """Ids and decoded text of every document (doc_id, text); with `digests` their SHA-256 instead."""
    schema = DIGEST if digests else OUT

    def run(batches):
        e = encoder(model_file)
        for b in batches:
            docs_ids, texts = arrow_column(b, "doc_id"), arrow_column(b, "text")
            for k in range(0, len(texts), 512):
                ids = [e.encode(t or "") for t in texts[k : k + 512]]
                out = {"doc_id": docs_ids[k : k + 512], "n_tokens": [len(x) // 4 for x in ids]}
                back = [e.decode(x) for x in ids]
                if digests:
                    out |= {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in back]}
                else:
                    out |= {"ids": ids, "decoded": back}
                yield record_batch(out, schema)

    kinds = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string")
    return docs.select("doc_id", "text").mapInArrow(run, kinds)
