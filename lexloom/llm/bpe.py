"""Byte-level BPE encoding of a whole corpus with a public rank file.

Each pre-token is merged with a priority queue of (rank, place) over a doubly linked list of
symbols; entries whose pair has changed since are stale and skipped.  Two shortcuts keep it exact:

* results are cached by string in a bounded cache, and
* before merging, a string is cut between two characters if no vocabulary entry can reach across
  that boundary: every symbol is a vocabulary entry, so no merge could ever cross it.

Defined results: null, empty text -> no ids.  Strings of special tokens are ordinary text.
Decoding concatenates vocabulary strings, so ``decode(encode(x)) == x`` for every text.
"""

from __future__ import annotations

import base64
import os
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .batches import map_columns

DEFAULT_FOLDER = "/opt/tokenizers"
# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CACHE_ENTRIES = 200_000


class ByteBPE:
    """Encoder and decoder of one rank file (lines of base64 bytes and rank)."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: piece for piece, rank in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.cache: dict[str, array] = {}
        self.joins: dict[tuple[str, str], bool] = {}
        self.seams = self._seams()
        self.first = [self.ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def _seams(self) -> set[tuple[bytes, bytes]]:
        """What stands right before and behind each character boundary inside an entry."""
        found = set()
        for piece in self.ranks:
            for k in range(1, len(piece)):
                if piece[k] & 0xC0 == 0x80:
                    continue
                a = k - 1
                while a > 0 and piece[a] & 0xC0 == 0x80:
                    a -= 1
                b = k + 1
                while b < len(piece) and piece[b] & 0xC0 == 0x80:
                    b += 1
                found.add((piece[a:k], piece[k:b]))
        return found

    def _joins(self, x: str, y: str) -> bool:
        """Whether some entry could reach from inside character ``x`` into character ``y``."""
        known = self.joins.get((x, y))
        if known is None:
            a, b = x.encode(), y.encode()
            known = any((a[i:], b[:j]) in self.seams for i in range(len(a)) for j in range(1, len(b) + 1))
            if len(self.joins) > 4 * _CACHE_ENTRIES:
                self.joins.clear()
            self.joins[x, y] = known
        return known

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token's bytes."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        n, first, get = len(word), self.first, ranks.get
        ends = [*range(1, n + 1), n]  # the symbol at i covers word[i:ends[i]]; its right neighbour starts at ends[i]
        before = [*range(-1, n)]
        pair = [first[a << 8 | b] for a, b in zip(word, word[1:])]
        queue = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        pair += (-1, -1)
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            if pair[i] != top >> 32:
                continue  # stale
            gone = ends[i]
            stop = ends[i] = ends[gone]
            pair[gone] = -1
            if stop < n:
                before[stop] = i
                r = pair[i] = get(word[i : ends[stop]], -1)
                if r >= 0:
                    heappush(queue, r << 32 | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                r = pair[h] = get(word[h:stop], -1)
                if r >= 0:
                    heappush(queue, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : ends[i]]])
            i = ends[i]
        return out

    def _word(self, piece: str) -> array:
        if piece.isascii() or len(piece) < 3:
            ids = array("i", self.merge(piece.encode()))
        else:
            ids, begin = array("i"), 0
            joins, cache = self.joins, self.cache
            for k in range(1, len(piece) + 1):
                if k < len(piece):
                    known = joins.get((piece[k - 1], piece[k]))
                    if known or known is None and self._joins(piece[k - 1], piece[k]):
                        continue
                part = piece[begin:k]
                got = cache.get(part)
                if got is None:
                    got = cache[part] = array("i", self.merge(part.encode()))
                ids += got
                begin = k
        if len(self.cache) >= _CACHE_ENTRIES:
            self.cache.clear()
        if len(piece) <= 64:
            self.cache[piece] = ids
        return ids

    def encode(self, text: str, into: array | None = None) -> array:
        """Token ids of ``text``, appended to ``into`` if given."""
        out = array("i") if into is None else into
        cache, word = self.cache, self._word
        for piece in self.pieces(text):
            try:
                out += cache[piece]
            except KeyError:
                out += word(piece)
        return out

    def count(self, text: str) -> int:
        cache, word = self.cache, self._word
        total = 0
        for piece in self.pieces(text):
            ids = cache.get(piece)
            total += len(word(piece) if ids is None else ids)
        return total

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> ByteBPE:
    """The tokenizer of a rank file; loaded once for each Python worker."""
    return ByteBPE(os.path.join(folder, f"{name}.tiktoken"))


def encode_ids(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """One row per document: its id and ``ids``; null and empty texts have an empty list.  Narrow."""

    def make(bpe, columns):
        flat, offsets = array("i"), [0]
        for text in columns["text"].to_pylist():
            if text:
                bpe.encode(text, flat)
            offsets.append(len(flat))
        values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.empty(0, np.int32))
        return {id_column: columns["key"], "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)}

    chosen = df.selectExpr(f"`{id_column}` AS key", f"`{text_column}` AS text")
    return map_columns(chosen, f"`{id_column}` bigint, ids array<int>", make, lambda: tokenizer(name, folder))


def count_ids(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """One row per document: its id and ``n_tokens``; 0 for null and empty texts.  Narrow."""

    def make(bpe, columns):
        return {id_column: columns["key"], "n_tokens": [bpe.count(t) if t else 0 for t in columns["text"].to_pylist()]}

    chosen = df.selectExpr(f"`{id_column}` AS key", f"`{text_column}` AS text")
    return map_columns(chosen, f"`{id_column}` bigint, n_tokens bigint", make, lambda: tokenizer(name, folder))


def decode_ids(df: DataFrame, id_column: str = "doc_id", name: str = "byte_bpe_50k", folder: str = DEFAULT_FOLDER) -> DataFrame:
    """The text of each row's ``ids``; an empty list gives the empty text, a null list null."""

    def make(bpe, columns):
        return {id_column: columns["key"], "text": [None if x is None else bpe.decode(x) for x in columns["ids"].to_pylist()]}

    chosen = df.selectExpr(f"`{id_column}` AS key", "ids")
    return map_columns(chosen, f"`{id_column}` bigint, text string", make, lambda: tokenizer(name, folder))
