"""BPE encoding by a tokenization automaton, and decoding by its arc labels.

The automaton over tokens starts with one state that every byte leads back
to. Merges are compiled in order, each by a gadget: merging a and b to ab
takes the arc b from the state after a, adds an arc ab wherever an arc a is,
and lets it end where b ended. The state after a token is therefore that of
its right part when it was made, less what later merges took. Arcs are kept as
these links, 3 numbers a merge, and followed on demand: the full table would
have vocabulary x vocabulary arcs.

Composed with the vocabulary's prefixes this gives a deterministic
transducer over bytes: a state knows the open suffix that a token may still
cover and the last token at each of its boundaries, and just one token
ending at the next byte has an arc from its boundary. Its table is filled as
states are met, one lookup a byte; tables are emptied at a fixed size, which
costs time and changes no result.
"""

from __future__ import annotations

import contextlib
import gc
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents
from tidelog.llm.textarrays import chunks

#: The pre-splitting pattern of byte-level BPE: a fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
START = -1
MOST_STATES, MOST_WORDS = 250_000, 300_000


def byte_alphabet() -> dict[str, int]:
    """Character to byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Automaton:
    """Tokens' arcs compiled from merges, and the byte transducer made from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = {raw(s): i for s, i in said["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.label = {i: b for b, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.token = vocab
        self.left, self.right, self.born, self.taken = {}, {}, dict.fromkeys(vocab.values(), -1), {}
        for rank, merge in enumerate(said["model"]["merges"]):
            a, b = (raw(s) for s in (merge if isinstance(merge, list) else merge.split(" ")))
            self._gadget(rank, vocab[a], vocab[b], vocab[a + b])
        self.open = {b[:k] for b in vocab for k in range(1, len(b))}
        self.split = regex.compile(SPLIT)
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.known: dict[tuple[int, int], bool] = {}
        self._clear()

    def _gadget(self, rank: int, a: int, b: int, ab: int) -> None:
        self.taken[a, b] = rank
        self.left[ab], self.right[ab], self.born[ab] = a, b, rank

    def _clear(self) -> None:
        self.names: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.step: list[dict[int, int]] = []
        self.last: list[int] = []
        self._state((b"", (START,)))

    def arc(self, x: int, y: int) -> bool:
        """Whether token y may follow token x."""
        found = self.known.get((x, y))
        if found is None:
            found = self.known[x, y] = self._follow(x, y)
        return found

    def _follow(self, x: int, y: int) -> bool:
        before = len(self.taken)
        while True:
            if self.taken.get((x, y), before) < before:
                return False
            if self.born[x] > self.born[y]:
                before, x = self.born[x], self.right[x]
            elif self.born[y] >= 0:
                before, y = self.born[y] + 1, self.left[y]  # of a a a the left two merge
            else:
                return True

    def _state(self, key: tuple) -> int:
        if key not in self.names:
            self.names[key] = len(self.keys)
            self.keys.append(key)
            self.step.append({})
            self.last.append(key[1][-1])
        return self.names[key]

    def _reach(self, state: int, byte: int) -> int:
        suffix, ends = self.keys[state]
        word = suffix + bytes((byte,))
        token = next(t for s in range(len(word)) if (t := self.token.get(word[s:])) is not None and (ends[s] == START or self.arc(ends[s], t)))
        cut = next(s for s in range(len(word) + 1) if s == len(word) or word[s:] in self.open)
        to = self.step[state][byte] = self._state((word[cut:], (*ends[cut:], token)))
        return to

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-split word: one transition a byte, then back over the last tokens."""
        if len(self.keys) > MOST_STATES:
            self._clear()
            self.known.clear()
        state, path = 0, []
        step, last = self.step, self.last
        for byte in word:
            to = step[state].get(byte)
            state = self._reach(state, byte) if to is None else to
            path.append(last[state])
        out, i = [], len(path)
        while i:
            out.append(path[i - 1])
            i -= len(self.label[path[i - 1]])
        return tuple(reversed(out))


class _Words(dict):
    """Ids by word, made where missing."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.automaton.encode_word(word.encode())
        if len(word) < 64:
            self[word] = ids
        return ids


class Codec:
    """Encodes and decodes whole texts; special tokens in a text keep their ids."""

    def __init__(self, path: str | None = None):
        self.automaton = Automaton(vocabulary_path(path))
        self.words = _Words(self.automaton)
        self.labels = [self.automaton.label.get(i, b"") for i in range(max(self.automaton.label) + 1)]

    def _plain(self, text: str) -> list[int]:
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        return list(chain.from_iterable(map(self.words.__getitem__, self.automaton.split.findall(text))))

    def encode(self, text: str) -> list[int]:
        a = self.automaton
        if not a.specials or not a.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in a.specials.finditer(text):
            out += [*self._plain(text[at : m.start()]), a.special[m.group()]]
            at = m.end()
        return out + self._plain(text[at:])

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str | None, Codec] = {}


def codec(path: str | None = None) -> Codec:
    """One codec a process and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


@contextlib.contextmanager
def _few_passes() -> Iterator[None]:
    """Fewer passes of the cycle collector, which find nothing in a codec's tables; as before afterwards."""
    before = gc.get_threshold()
    gc.freeze()
    gc.set_threshold(200_000, 50, 50)
    try:
        yield
    finally:
        gc.set_threshold(*before)
        gc.unfreeze()


def encoded(df: DataFrame, text: str = "text", path: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """(row, ids): kept columns (all if None) as a struct, and the ids of each whole text.

    A null text counts as empty and gives no ids. Rows are treated one by one,
    so repeated rows, an empty table and extra columns of any name are fine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in chunks(batches, "text"):
            with _few_passes():
                ids = [c.encode(t or "") for t in b.column("text").to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, ends[-1])
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["row", "ids"])

    x = df.select(F.struct(*[F.col(f"`{k}`") for k in (df.columns if keep is None else keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, ids array<int>")


def decoded(df: DataFrame, path: str | None = None) -> DataFrame:
    """(row, ids, decoded) from (row, ids): the joined arc labels; bytes that are no UTF-8 become U+FFFD, null ids a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [None if ids is None else c.decode(ids) for ids in (s.values.to_numpy(zero_copy_only=False).tolist() if s.is_valid else None for s in part.column("ids"))]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), pa.array(texts, pa.string())], ["row", "ids", "decoded"])

    return df.mapInArrow(run, f"row {df.schema['row'].dataType.simpleString()}, ids array<int>, decoded string")


def op7_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every whole text."""
    out = decoded(encoded(documents(spark, sf_dir).select("doc_id", "text"), path=path, keep=["doc_id"]), path=path)
    return out.selectExpr("row.doc_id AS doc_id", "CAST(size(ids) AS BIGINT) AS n_tokens", "sha2(array_join(ids, ','), 256) AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")
