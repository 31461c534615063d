"""Runs of words that repeat with a period, found through all tandem repeats of a text.

Ziv-Lempel blocks give, by extensions to both sides of block borders, the
leftmost tandem repeats, from which turning by one word leads to all others.
They are located in a suffix tree and turned there, along suffix links, until
the vocabulary of tandem repeats is complete; the leaves below an entry are
all places where it stands. Entries whose half is a repetition itself belong
to a shorter period and are left out, so what is located is at most n log n.
Places of one period that follow on each other are one run.

Only words in stretches of a text that come twice in it, as long as a run's
overlap with itself must be, can be in a run, so the tree is built for these
stretches alone, of many texts together, with borders that occur once. A text
is treated whole in its task; what this takes grows with its own stretches.

The tree is held as sorted suffixes: a node is an interval of them, named by
the leftmost place of the least common prefix in it. Names of all factors of
power-of-two lengths give the order and, by halving steps, common extensions
both ways.

A null text has no words. Rows are treated one by one, so repeated rows, an
empty table and extra columns of any name are fine.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents
from tidelog.llm.textarrays import chunks, mix, word_hashes

#: Words and exponent that a run has at least.
SHORTEST, EXPONENT = 24, 3
#: Words of stretches that share a tree, or one stretch.
TOGETHER = 60_000


def _ranges(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers first[i] to first[i] + n[i] - 1, and i beside each."""
    of = np.repeat(np.arange(len(n)), n)
    return first[of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of


class Factors:
    """Names of the factors of s of lengths 1, 2, 4, ...: equal for equal factors, in their order. s ends with a letter that occurs once."""

    def __init__(self, s: np.ndarray):
        self.n = n = len(s)
        self.names = [np.append(np.unique(s, return_inverse=True)[1], -1)]
        while self.names[-1].max() < n - 1:
            one, step = self.names[-1], 1 << (len(self.names) - 1)
            two = np.full(n, -1, np.int64)
            two[: n - step] = one[step:n]
            key = one[:n] * (n + 1) + two + 1
            order = np.argsort(key)
            name = np.empty(n + 1, np.int64)
            name[order] = np.concatenate(([0], np.cumsum(key[order[1:]] != key[order[:-1]])))
            name[n] = -1
            self.names.append(name)
        self.rank = self.names[-1][:n]
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[self.rank] = np.arange(n)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the suffixes at i and j, which differ, have in common."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            out += (self.names[k][i + out] == self.names[k][j + out]) << k
        return out

    def back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Letters that the prefixes up to i and j, both included, have in common at their ends; -1 is the empty prefix."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            out += ((a >= 0) & (b >= 0) & (self.names[k][np.maximum(a, 0)] == self.names[k][np.maximum(b, 0)])) << k
        return out


class Tree:
    """The suffix tree of s: leaves 0 to n - 1 by order of suffixes, inner nodes from n on."""

    def __init__(self, s: np.ndarray, factors: Factors):
        self.s, self.n, self.f = s, (n := factors.n), factors
        sa, rank = factors.suffixes, factors.rank
        lcp = np.zeros(n + 1, np.int64)
        lcp[1:n] = factors.ahead(sa[:-1], sa[1:])
        lcp[0] = lcp[n] = -1
        self.lcp = lcp
        rows = [(lcp[:n] << 32) | np.arange(n)]
        while 2 << (len(rows) - 1) <= n:
            half = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
        self.rows = rows
        at = np.arange(1, n)
        lo, hi = self.around(at, lcp[1:n])
        self.owner = np.concatenate(([0], self.least(lo + 1, hi)))  # the place that names the node of each common prefix
        self.inner = np.flatnonzero(self.owner == np.arange(n))[1:]
        self.low, self.high = np.concatenate((np.arange(n), np.zeros(n, np.int64))), np.concatenate((np.arange(n), np.zeros(n, np.int64)))
        self.low[n + at], self.high[n + at] = lo, hi
        self.depth = np.concatenate((n - sa, lcp[:n]))
        self.first = sa[self.low]
        nodes = np.concatenate((np.arange(n), n + self.inner))
        left, right = lcp[self.low[nodes]], lcp[self.high[nodes] + 1]
        up = np.where(left >= right, self.low[nodes], self.high[nodes] + 1)
        self.parent = np.full(2 * n, -1, np.int64)
        top = np.maximum(left, right) < 0  # the root
        self.root = int(nodes[top][0])
        kids = nodes[~top]
        self.parent[kids] = n + self.owner[up[~top]]
        letters = self.letters = int(s.max()) + 1
        key = self.parent[kids] * letters + s[self.first[kids] + self.depth[self.parent[kids]]]
        self.child = dict(zip(key.tolist(), kids.tolist()))
        self.link = np.full(2 * n, self.root, np.int64)
        v = n + self.inner
        v = v[self.depth[v] > 0]
        a, b = rank[sa[self.low[v]] + 1], rank[sa[self.high[v]] + 1]
        self.link[v] = n + self.owner[self.least(np.minimum(a, b) + 1, np.maximum(a, b))]

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The leftmost place of the least common prefix in lo to hi."""
        k = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for j in np.unique(k).tolist():
            m = k == j
            out[m] = np.minimum(self.rows[j][lo[m]], self.rows[j][hi[m] - (1 << j) + 1])
        return out & 0xFFFFFFFF

    def around(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that share their first length letters with the one at a rank."""
        lo, hi, want = at.copy(), at.copy(), length << 32
        for k in range(len(self.rows) - 1, -1, -1):
            row, step = self.rows[k], 1 << k
            j = lo - step
            lo = np.where((j >= 0) & (row[np.maximum(j + 1, 0)] >= want), j, lo)
            j = hi + step
            hi = np.where((j < self.n) & (row[np.minimum(hi + 1, len(row) - 1)] >= want), j, hi)
        return lo, hi

    def located(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The node at or below the end of each factor."""
        lo, hi = self.around(self.f.rank[start], length)
        out = lo.copy()
        wide = lo < hi
        out[wide] = self.n + self.least(lo[wide] + 1, hi[wide])
        return out


def _blocks(suffixes: list[int], lcp: list[int]) -> list[int]:
    """Starts of the Ziv-Lempel blocks and the end: a block is the longest factor that began before, or a new letter."""
    n = len(suffixes)
    longest, stack = [0] * n, []
    for at, common in zip([*suffixes, -1], [*lcp[:n], 0]):
        while stack and stack[-1][0] > at:
            top, below = stack.pop()
            longest[top] = max(below, common)
            common = min(below, common)
        stack.append((at, common))
    out = [0]
    while out[-1] < n:
        out.append(out[-1] + max(1, longest[out[-1]]))
    return out


def _leftmost(f: Factors, blocks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of tandem repeats whose turnings are all: those over the end and those over the start of each block."""
    b = np.array(blocks, np.int64)
    h, end, after = b[:-1], b[1:], np.append(b[2:], b[-1])
    inside = np.flatnonzero(end < f.n)
    k, of = _ranges(np.ones(len(inside), np.int64), (end - h)[inside])
    e = end[inside][of]
    q = e - k
    k1, k2 = f.ahead(e, q), f.back(e - 1, q - 1)
    good = (k1 + k2 >= k) & (k1 > 0)
    starts, halves = [np.maximum(q - k2, q - k + 1)[good]], [k[good]]
    k, of = _ranges(np.ones(len(h), np.int64), after - h)
    keep = h[of] + k < f.n
    k, of = k[keep], of[keep]
    q = h[of] + k
    k1, k2 = f.ahead(h[of], q), f.back(h[of] - 1, q - 1)
    start = np.maximum(h[of] - k2, h[of] - k + 1)
    good = (k1 + k2 >= k) & (k1 > 0) & (k2 > 0) & (start + k <= end[of])
    return np.concatenate((*starts, start[good])), np.concatenate((*halves, k[good]))


def _vocabulary(t: Tree, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, length) of all tandem repeats: each located one is turned by a word along suffix links until it is known or occurs no more."""
    s, parent, depth, first, link = (x.tolist() for x in (t.s, t.parent, t.depth, t.first, t.link))
    child, letters, root = t.child, t.letters, t.root
    nodes, lengths, known = [], [], set()
    wide = 2 * t.n + 1
    for v, length in zip(t.located(start, 2 * half).tolist(), (2 * half).tolist()):
        while (key := v * wide + length) not in known:
            known.add(key)
            nodes.append(v)
            lengths.append(length)
            i, u, end = first[v], parent[v], length - 1
            w, d = (root, 0) if u == root else (link[u], depth[u] - 1)
            while d < end:
                w = child[w * letters + s[i + 1 + d]]
                d = depth[w]
            if d == end:
                w = child.get(w * letters + s[i])
                if w is None:
                    break
            elif s[first[w] + end] != s[i]:
                break
            v = w
    return np.array(nodes, np.int64), np.array(lengths, np.int64)


def _primes(k: int) -> list[int]:
    out, p = [], 2
    while p * p <= k:
        if k % p == 0:
            out.append(p)
            while k % p == 0:
                k //= p
        p += 1
    return out + [k] * (k > 1)


def _primitive(f: Factors, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether each factor is no repetition of a shorter one."""
    kinds, of = np.unique(half, return_inverse=True)
    parts = [[k // p for p in _primes(k)] for k in kinds.tolist()]
    n = np.array([len(x) for x in parts], np.int64)
    flat = np.array(list(chain.from_iterable(parts)), np.int64)
    at, row = _ranges((np.cumsum(n) - n)[of], n[of])
    period = flat[at]
    whole = f.ahead(start[row], start[row] + period) >= half[row] - period
    return np.bincount(row[whole], minlength=len(start)) == 0


def runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal repetitions of s, of two periods or more; s ends with a letter that occurs once."""
    none = np.zeros(0, np.int64)
    if len(s) < 3:
        return none, none, none
    f = Factors(s)
    t = Tree(s, f)
    start, half = _leftmost(f, _blocks(f.suffixes.tolist(), t.lcp.tolist()))
    if not len(start):
        return none, none, none
    node, length = _vocabulary(t, start, half)
    keep = _primitive(f, t.first[node], length // 2)
    node, half = node[keep], length[keep] // 2
    at, of = _ranges(t.low[node], t.high[node] - t.low[node] + 1)
    place, period = f.suffixes[at], half[of]
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.flatnonzero(np.concatenate(([True], (period[1:] != period[:-1]) | (place[1:] != place[:-1] + 1))))
    last = np.append(new[1:], len(place)) - 1
    return place[new], place[last] - place[new] + 2 * period[new], period[new]


def _stretches(texts: list[bytes], shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of the stretches of words in which every word is in a factor that its text has twice.

    A run and its copy one period on overlap by shortest less a period or by
    all periods but one, so by this many words at least. Factors are told
    apart by hashes, which may join two, never part equal ones.
    """
    width = max(1, shortest * (exponent - 1) // exponent)
    doc, h = word_hashes(texts)
    n = len(h) - width + 1
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    own = np.flatnonzero(doc[:n] == doc[width - 1 :])
    value = doc[own].astype(np.uint64)
    for k in range(width):
        value = mix(value * np.uint64(0x2545F4914F6CDD1D) + h[own + k])
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(own), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, own[twice], 1)
    np.add.at(edge, own[twice] + width, -1)
    inside = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    cut = np.zeros(len(inside), bool)  # a stretch ends with its text
    cut[1 : len(h)] = doc[1:] != doc[:-1]
    first = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[: len(h)]))
    last = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1 : len(h) + 1])) + 1
    at = np.searchsorted(doc, np.arange(len(texts)))
    return doc[first], first - at[doc[first]], last - at[doc[first]]


def _found(texts: list[bytes], shortest: int, exponent: int) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, in order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    letters: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    where: list[tuple[int, int, int]] = []  # (place in parts laid end to end, text, place in the text)
    held = 0

    def settle() -> None:
        nonlocal held
        if parts:
            s = np.concatenate([np.append(p, len(letters) + i) for i, p in enumerate(parts)])
            start, length, period = runs(s)
            good = length >= np.maximum(shortest, exponent * period)
            starts = np.array([w[0] for w in where], np.int64)
            of = np.searchsorted(starts, start[good], "right") - 1
            for i, a, n, p in zip(of.tolist(), start[good].tolist(), length[good].tolist(), period[good].tolist()):
                out[where[i][1]].append((a - where[i][0] + where[i][2], n, p))
        letters.clear()
        parts.clear()
        where.clear()
        held = 0

    doc, first, last = _stretches(texts, shortest, exponent)
    words, of = [], -1
    for d, a, z in zip(doc.tolist(), first.tolist(), last.tolist()):
        if held and held + z - a > TOGETHER:
            settle()
        if d != of:
            words, of = texts[d].split(), d
        parts.append(np.array([letters.setdefault(w, len(letters)) for w in words[a:z]], np.int64))
        where.append((held, d, a))
        held += z - a + 1
    settle()
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def _collapsed(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """The words of text joined by one space, without those that a run has after its first period."""
    words = text.split()
    if found:
        gone = np.zeros(len(words) + 1, np.int64)
        for start, length, period in found:
            gone[start + period] += 1
            gone[start + length] -= 1
        words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
    return b" ".join(words)


def periodic(df: DataFrame, text: str = "text", keep: list[str] | None = None, shortest: int = SHORTEST, exponent: int = EXPONENT) -> DataFrame:
    """(row, runs, collapsed): kept columns (all if None), the runs (start, length, period) in words by start and period, and the text without their repeats.

    A run has its smallest period, cannot be extended, and has at least
    shortest words and exponent (2 or more) periods.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            texts = [t.encode() if t else b"" for t in b.column("text").to_pylist()]
            found = _found(texts, shortest, exponent)
            ends = np.concatenate(([0], np.cumsum([len(r) for r in found])))
            flat = np.array(list(chain.from_iterable(found)), np.int64).reshape(-1, 3)
            each = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], ["start", "length", "period"])
            left = pa.array(list(map(_collapsed, texts, found)), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), left], ["row", "runs", "collapsed"])

    x = df.select(F.struct(*[F.col(f"`{k}`") for k in (df.columns if keep is None else keep)]).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return x.mapInArrow(run, f"row {x.schema['row'].dataType.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def planted(id: Column, text: Column) -> Column:
    """text, with one in ten made periodic from a place on, place and period by a hash of id."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.slice(F.concat(F.slice(words, F.lit(1), a), again), F.lit(1), n)
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), runs_sha256, collapsed_sha256, of the planted texts."""
    docs = documents(spark, sf_dir).select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    x = periodic(docs, keep=["doc_id"])
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]  # noqa: E731 - runs are in order of start and period, so the first of equals stays
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(more(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = x.select(F.col("row.doc_id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("(1000 * b.length) div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
