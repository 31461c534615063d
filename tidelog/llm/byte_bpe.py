"""Byte-level BPE over a table of ranks, in two tiers, and decoding to bytes.

A pre-token that is in the vocabulary is its own id: all pre-tokens of a
batch are hashed together and go through a minimal perfect hash of the
vocabulary, whose answer is compared byte by byte, so that others are never
taken for one. The rest are merged from their bytes: the bytes are linked to
their neighbours, and a heap has the pairs that are in the vocabulary, least
rank and then leftmost first; a merge relinks its neighbours and adds at most
two pairs, so long pre-tokens take n log n steps.

Strings of special tokens are ordinary text. A null text counts as empty and
gives no ids. Rows are treated one by one, so repeated rows, an empty table
and extra columns of any name are fine.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.bpe import SPLIT
from tidelog.llm.common import documents
from tidelog.llm.textarrays import chunks, mix, spans_hashed

MOST_WORDS = 200_000


def ranks_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token to rank from lines of a token in Base64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


class PerfectHash:
    """Numbers n distinct 64-bit hashes from 0 to n - 1.

    Each level is a row of bits, two for each hash that is left: hashes alone
    at their bit stay there, the others go to the next level. A hash's number
    is the count of set bits before its own. Other hashes get any number or -1.
    """

    def __init__(self, hashes: np.ndarray):
        self.sizes, rows = [], []
        while len(hashes):
            size = 2 * len(hashes) + 1
            at = self._at(hashes, len(rows), size)
            alone = np.bincount(at, minlength=size) == 1
            self.sizes.append(size)
            rows.append(alone)
            hashes = hashes[~alone[at]]
        self.bits = np.concatenate([*rows, np.zeros(1, bool)])
        self.before = np.cumsum(self.bits) - self.bits
        self.starts = np.concatenate(([0], np.cumsum(self.sizes))).astype(np.int64)

    @staticmethod
    def _at(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes, level + 1) % np.uint64(size)).astype(np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (start, size) in enumerate(zip(self.starts, self.sizes)):
            at = start + self._at(hashes[left], level, size)
            found = self.bits[at]
            out[left[found]] = self.before[at[found]]
            left = left[~found]
        return out


class Vocabulary:
    """Whole pre-tokens by perfect hash; all tokens laid end to end for the comparison."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        tokens = list(ranks)
        hashes = spans_hashed(tokens)
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two tokens share a hash")
        self.number = PerfectHash(hashes)
        order = np.argsort(self.number(hashes))
        self.ids = np.fromiter(ranks.values(), np.int64, len(tokens))[order]
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))[order]
        self.blob = np.frombuffer(b"".join(tokens[i] for i in order.tolist()), np.uint8)
        self.starts, self.sizes = np.cumsum(sizes) - sizes, sizes

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """The id of each word, -1 where it is none."""
        at = self.number(spans_hashed(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        maybe = np.flatnonzero((at >= 0) & (self.sizes[at] == sizes) & (sizes > 0))
        out = np.full(len(words), -1, np.int64)
        if len(maybe):
            n = sizes[maybe]
            first = np.cumsum(n) - n
            own = np.frombuffer(b"".join(words[i] for i in maybe.tolist()), np.uint8)
            theirs = self.blob[np.repeat(self.starts[at[maybe]] - first, n) + np.arange(len(own))]
            same = np.logical_and.reduceat(own == theirs, first)
            out[maybe[same]] = self.ids[at[maybe[same]]]
        return out


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word by its merges: the pair of least rank, then the leftmost, until no two neighbours make a token.

    A pair's rank, start and end are one number on the heap.
    """
    n = len(word)
    bits = n.bit_length()
    mask = (1 << bits) - 1
    after, before = list(range(1, n + 2)), list(range(-1, n))  # after[i] is 0 where i has been merged away
    rank = ranks.get
    heap = [(r << bits | i) << bits | i + 2 for i in range(n - 1) if (r := rank(word[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        top = heappop(heap)
        end, i = top & mask, top >> bits & mask
        j = after[i]
        if not j or j >= end or after[j] != end:
            continue  # one of the two has been merged since
        after[j] = 0
        after[i] = end
        before[end] = i
        if end < n and (r := rank(word[i : (last := after[end])])) is not None:
            heappush(heap, (r << bits | i) << bits | last)
        p = before[i]
        if p >= 0 and (r := rank(word[p:end])) is not None:
            heappush(heap, (r << bits | p) << bits | end)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[word[i:j]])
        i = j
    return out


class Codec:
    """Encodes batches of whole texts and decodes ids to bytes."""

    def __init__(self, path: str | None = None):
        self.ranks = read_ranks(ranks_path(path))
        self.vocabulary = Vocabulary(self.ranks)
        self.labels = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            self.labels[i] = token
        self.split = regex.compile(SPLIT)
        self.missed: dict[str, tuple[int, ...]] = {}

    def _resolved(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Ids of distinct pre-tokens; those merged before are kept while they are few and short."""
        found = dict(zip(words, map(self.missed.get, words)))
        new = [w for w, ids in found.items() if ids is None]
        raw = [w.encode() for w in new]
        if len(self.missed) > MOST_WORDS:
            self.missed.clear()
        for w, b, i in zip(new, raw, self.vocabulary(raw).tolist()):
            if i >= 0:
                found[w] = (i,)
            else:
                found[w] = tuple(merged(b, self.ranks))
                if len(b) < 64:
                    self.missed[w] = found[w]
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        split = [self.split.findall(t) for t in texts]
        ids = self._resolved(list(dict.fromkeys(chain.from_iterable(split))))
        return [list(chain.from_iterable(map(ids.__getitem__, words))) for words in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


_codecs: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One codec a process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, ids): kept columns (all if None) as a struct, and the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in chunks(batches, "text"):
            ids = c.encode([t or "" for t in b.column("text").to_pylist()])
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["row", "ids"])

    x = df.select(F.struct(*[F.col(f"`{k}`") for k in (df.columns if keep is None else keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """(row, ids, decoded) from (row, ids): the tokens' bytes joined; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raw = [None if ids is None else c.decode(ids) for ids in (s.values.to_numpy(zero_copy_only=False).tolist() if s.is_valid else None for s in part.column("ids"))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(raw, pa.binary())], ["row", "ids", "decoded"])

    return df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, ids array<int>, decoded binary")


def op12_byte_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (of the decoded bytes) for every whole text."""
    out = decoded(encoded(documents(spark, sf_dir).select("doc_id", "text"), path=path, keep=["doc_id"]), path=path)
    return out.selectExpr("row.doc_id AS doc_id", "CAST(size(ids) AS BIGINT) AS n_tokens", "sha2(array_join(ids, ','), 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
