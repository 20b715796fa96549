"""Byte-level BPE by monoid tree reduction: halves are encoded apart and joined at their seam."""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points of a leaf of the tree that encodes; ids of a leaf of the tree that decodes.
LEAF = 512
#: Bytes of one piece that are merged at once; longer pieces are reduced as a tree themselves.
PIECE = 32
#: Pieces, and pairs of neighbours, whose ids a worker process remembers.
REMEMBERED = 1 << 17
#: Ends of runs where every split of the pattern has a border, whatever stands around: nothing in it spans text
#: then white space, a letter then something else, or a digit then something else. ASCII only, which is enough.
BORDER = re.compile(r"(?<![A-Za-z])[A-Za-z]++(?=[\x00-@\[-`{-\x7F])|(?<![0-9])[0-9]++(?=[\x00-/:-\x7F])|(?<![^\sA-Za-z0-9])[^\sA-Za-z0-9]++(?=[ \t\n\r])")


def _doubled(w: int, most: int) -> Iterator[int]:
    """w, 2 w, 4 w, and so on below ``most``."""
    while w < most:
        yield w
        w *= 2


class TreeBPE:
    """Encoder and decoder of one vocabulary (base64 token and rank a line) and split pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(f"(?:{pattern})")  # without groups, findall() gives whole matches
        self.token = {v: k for k, v in self.rank.items()}
        self.width = {v: len(k) for k, v in self.rank.items()}
        self.known, self.older = {}, {}  # ids of pieces: as remembered of late, and before that
        self.pairs: dict[tuple[int, int], bool] = {}

    def encode(self, text: str) -> array:
        """Ids of the text: leaves of LEAF code points are encoded, neighbours joined up the tree."""
        return self._reduce(text, 0, len(text))

    def _reduce(self, text: str, lo: int, hi: int) -> array:
        # A stretch without a border is left to the trees of its pieces.
        if hi - lo <= LEAF or not BORDER.search(text, lo, hi):
            return array("I", self._window(text[lo:hi]))
        # A blank near the middle makes halves of whole words, which are known already; without one any place will do.
        mid = (lo + hi) // 2
        blank = text.rfind(" ", max(lo + 1, mid - 16), mid)
        mid = blank if blank > 0 else mid
        left, right = self._reduce(text, lo, mid), self._reduce(text, mid, hi)
        # Ids of text[lo:hi] from those of its halves: the window around the seam grows on either side to
        # a border that holds in any context, or to the end of the half. The ids of the halves outside are
        # then those of the whole, and the window's are encoded anew.
        p, q = lo, hi
        for w in _doubled(16, mid - lo):
            if found := [m.end() for m in BORDER.finditer(text, mid - w, mid)]:
                p = found[-1]
                break
        for w in _doubled(16, hi - mid):
            if found := BORDER.search(text, mid, mid + w):
                q = found.end()
                break
        # A border is one of ids too: those of the window are the last, and the first, of so many bytes.
        width, i, j = self.width, 0, len(right)
        if p > lo:
            i, n = len(left), len(text[p:mid].encode("utf-8"))
            while n > 0:
                i -= 1
                n -= width[left[i]]
        if q < hi:
            j, n = 0, len(text[mid:q].encode("utf-8"))
            while n > 0:
                n -= width[right[j]]
                j += 1
        return left[:i] + array("I", self._window(text[p:q])) + right[j:]

    def _window(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.known.get
        for t in self.pattern.findall(text):
            out += known(t) or self._learned(t)
        return out

    def _learned(self, t: str) -> list[int]:
        """Ids of a piece not met of late. Pieces are remembered in two ages, so rare ones make no frequent one forgotten."""
        ids = self.older.get(t) or self.piece(t.encode("utf-8"))
        if len(t) <= PIECE:
            if len(self.known) >= REMEMBERED:
                self.older = dict(self.known)
                self.known.clear()
            self.known[t] = ids
        return ids

    def piece(self, b: bytes) -> list[int]:
        """Ids of one match of the pattern.

        A sequence of ids is the encoding of its bytes if each pair of neighbours, encoded
        together, gives the pair again. So the window at the seam grows, in ids, until both
        pairs at its ends do.
        """
        if len(b) <= PIECE:
            return self._merged(b)
        left, right = self.piece(b[: len(b) // 2]), self.piece(b[len(b) // 2 :])
        k = 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            seam = b"".join(self.token[x] for x in left[i:] + right[:j])
            inner = self._merged(seam)
            if (i == 0 or self._stable(left[i - 1], inner[0])) and (j == len(right) or self._stable(inner[-1], right[j])):
                return left[:i] + inner + right[j:]
            k *= 2

    def _merged(self, b: bytes) -> list[int]:
        """Bytes merged by rank: of all neighbours that make a token, the pair of least rank, the leftmost of equals, time and again."""
        if b in self.rank:
            return [self.rank[b]]
        if len(b) > 4 * PIECE:
            return self._merged_long(b)
        rank, none = self.rank.get, len(self.rank)
        parts = [b[k : k + 1] for k in range(len(b))]
        ranks = [rank(b[k : k + 2], none) for k in range(len(b) - 1)]  # of each part joined with the next
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            parts[k] += parts.pop(k + 1)
            ranks.pop(k)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], none)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
        return [self.rank[x] for x in parts]

    def _merged_long(self, b: bytes) -> list[int]:
        """The same with the pairs in a heap, for seams that grew long."""
        rank, none = self.rank.get, len(self.rank)
        n = len(b)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place
        pair = [rank(b[k : k + 2], none) for k in range(n - 1)] + [none]
        heap = [(r, k) for k, r in enumerate(pair) if r < none]
        heapify(heap)
        while heap:
            r, k = heappop(heap)
            if pair[k] != r:
                continue
            gone = end[k]
            end[k] = end[gone]
            before[end[k]] = k
            pair[gone] = none
            for at in (before[k], k):
                if at >= 0:
                    pair[at] = rank(b[at : end[end[at]]], none) if end[at] < n else none
                    if pair[at] < none:
                        heappush(heap, (pair[at], at))
        out, k = [], 0
        while k < n:
            out.append(self.rank[b[k : end[k]]])
            k = end[k]
        return out

    def _stable(self, a: int, b: int) -> bool:
        same = self.pairs.get((a, b))
        if same is None:
            if len(self.pairs) >= REMEMBERED:
                self.pairs.clear()
            same = self.pairs[a, b] = self._merged(self.token[a] + self.token[b]) == [a, b]
        return same

    def decode(self, ids: array | list[int]) -> bytes:
        """Bytes of the ids: leaves decoded, halves concatenated up the tree."""
        if len(ids) <= LEAF:
            return b"".join([self.token[x] for x in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


@lru_cache(maxsize=4)
def coder(path: str, pattern: str) -> TreeBPE:
    """One coder a worker process; the vocabulary is read where the task runs."""
    return TreeBPE(path, pattern)


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of each whole text, without special tokens; null counts as empty.

    The vocabulary's path must be readable on the executors. Texts never leave their task;
    one row per row of ``docs``, repeated ones too, and an empty array for an empty text. An empty
    table gives an empty result.
    """
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                yield pd.DataFrame({"doc_id": part.doc_id, "ids": [np.asarray(c.encode(t or "")).astype(np.int32) for t in part.text]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(encoded, f"doc_id {kind}, ids array<int>")


def bpe_decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, decoded binary: the bytes that the ids stand for; null ids count as none, an empty table gives an empty result."""
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def decoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for b in batches:
            for k in range(0, len(b), 256):
                part = b.iloc[k : k + 256]
                yield pd.DataFrame({"doc_id": part.doc_id, "decoded": [c.decode(list(x) if x is not None else []) for x in part.ids]})

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInPandas(decoded, f"doc_id {kind}, decoded binary")


def bpe_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, and digest both in one pass.

    One row per row of ``docs``; null and empty texts have no ids, and an empty table gives an
    empty result.
    """
    path, pattern = path or defaults()[0], pattern or defaults()[1]

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path, pattern)
        for b in batches:
            rows = []
            for t in b.text:
                ids = c.encode(t or "")
                rows.append((len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
            yield pd.DataFrame({"doc_id": b.doc_id} | {k: [r[i] for r in rows] for i, k in enumerate(("n_tokens", "ids_sha256", "decoded_sha256"))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(digests, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_round_trip(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document; null text counts as empty."""
    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
