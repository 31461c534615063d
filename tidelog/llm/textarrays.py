"""Array arithmetic over many texts at once: words, hashes and shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.int64).astype(_U)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}
#: Bytes hashed at a time, up to the end of a word.
PIECE = 1 << 18


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x + _U((seed * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, base, _U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["up"][:n], _powers["down"][:n]


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose texts have most bytes together at most, or one row."""
    for b in batches:
        sizes = [len(s.as_buffer()) if s.is_valid else 0 for s in b.column(column)] if b.num_rows else []
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start)
    pa.default_memory_pool().release_unused()  # what a task held is not kept for the worker's next one


def encoded(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [s.as_buffer().to_pybytes() if s.is_valid else b"" for s in column]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, 64-bit hash) of each word of texts, in order."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    blob = np.frombuffer(b" ".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
    spaces = np.flatnonzero(_IS_SPACE[blob])
    after = np.searchsorted(spaces, np.arange(PIECE, len(blob), PIECE))
    cuts = np.unique(np.concatenate(([0], spaces[after[after < len(spaces)]], [len(blob)]))).tolist()
    docs, hashes = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
    for i, j in zip(cuts, cuts[1:]):  # where in a piece a word stands does not change its hash
        b = blob[i:j]
        solid = np.concatenate(([False], ~_IS_SPACE[b], [False]))
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        first, last = edges[::2], edges[1::2]
        if not len(first):
            continue
        up, down = _power(len(b))
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b] * up)))
        h = (total[last] - total[first]) * down[first] + (last - first).astype(_U)
        docs.append(np.searchsorted(starts, first + i, "right") - 1)
        hashes.append(mix(h))
    return np.concatenate(docs), np.concatenate(hashes)


def spans_hashed(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each of words, of any bytes."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends, out, i = np.cumsum(sizes), np.zeros(len(words), _U), 0
    while i < len(words):  # pieces of bounded size, a longer word alone
        j = max(i + 1, int(np.searchsorted(ends, (ends[i] - sizes[i]) + PIECE, "right")))
        b = np.frombuffer(b"".join(words[i:j]), np.uint8)
        up, down = _power(len(b) + 1)
        total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTE[b] * up[:-1])))
        last = ends[i:j] - (ends[i] - sizes[i])
        first = last - sizes[i:j]
        out[i:j] = mix((total[last] - total[first]) * down[first] + sizes[i:j].astype(_U))
        i = j
    return out


def shingle_sets(texts: list[bytes], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): the sorted distinct shingle hashes of each text.

    A text with fewer words than width has its whole word sequence as its one
    shingle; one without words has none.
    """
    doc, h = word_hashes([t.lower() for t in texts])  # bytes: A-Z only
    words = np.bincount(doc, minlength=len(texts))
    value = np.full(len(h), width, _U)
    for k in range(width):
        value = mix(value * _U(0x2545F4914F6CDD1D) + np.concatenate((h[k:], np.zeros(min(k, len(h)), _U))))
    left = np.cumsum(words)[doc] - np.arange(len(h))  # words from here to the end of the text
    keep = left >= width
    short = np.flatnonzero((words > 0) & (words < width))
    at = np.cumsum(words) - words
    one = np.zeros(len(short), _U) + words[short].astype(_U)
    for k in range(width - 1):
        there = words[short] > k
        one[there] = mix(one[there] * _U(0x2545F4914F6CDD1D) + h[at[short[there]] + k])
    doc, value = np.concatenate((doc[keep], short)), np.concatenate((value[keep], one))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value = doc[new], value[new]
    return np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(texts))))), value


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows that agree in keys, from batches sorted by keys; the caller bounds the size of a group."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in keys:
            v = b.column(k).to_numpy(zero_copy_only=False)
            change |= v[1:] != v[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for i, j in zip(cuts, cuts[1:]):
            if held and i:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)
