"""N-gram Jaccard join with count-vector R-trees.

Shingles are hashed into token groups. Two sets of n and m shingles with
similarity s or more differ in (n + m)(1 - s) / (1 + s) shingles at most, so
with one group more than that some group is the same in both: documents meet
by equi-join on the content of a group, once for each size class and the
next. At lower similarities such groups would be small, so groups are half as
many, and documents meet by two of the three parts of a group. Documents that
meet form families.

A family is indexed as an R-tree over its points of group counts: points in
order of size and counts are cut into blocks, blocks into inner nodes, and
these into one node a family; inside a block are leaves. The tree is
joined with itself from the top down. At every level the summed minima of two
upper corners bound the overlap of what is below, so pairs of nodes that
cannot link go before a set is copied. Pairs of blocks get finer counts of
their sets first, then the sets that these leave a partner; those are verified.

Equal sets are one vertex from the start, and what is connected already is
not compared, so that copies never expand into all pairs: first every block
is compared with itself and the next one, then the pairs that the tree join
leaves where several components remain. Nothing is dropped: the result is
exact up to 64-bit hash collisions.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import documents, scratch, written
from tidelog.llm.graph import components
from tidelog.llm.textarrays import chunks, encoded, groups, mix, shingle_sets

_U = np.uint64
#: Coordinates of a point.
COUNTS = 32
LEAF = 32
#: Shingles for each of the finer counts at most, by which sets are chosen that are dealt out.
FINE = 4
#: Sets and shingles of a block at most (its last set may go beyond).
BLOCK_SETS, BLOCK_SHINGLES = 2048, 1_000_000
#: Sets of a block that are held against all others at a time.
ROWS = 256
#: Blocks below an inner node at most.
FAN_OUT = 32
#: Times that a set is dealt to pairs of blocks in a round, on average.
DEALT = 4
#: Rows whose keys are combined before they are dealt out, and the head of a row that has met no other yet.
COMBINED, ALONE = 500_000, -(1 << 63)
#: Similarity from which single token groups hold shingles enough (9 at 0.9) to be met by; below, parts of groups are combined.
SINGLE_GROUPS = Fraction(17, 20)
#: Family members up to which their ids are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows of eight numbers up to which they are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def size_classes(similarity: Fraction, upto: int) -> tuple[np.ndarray, np.ndarray]:
    """(last size, token groups) of each class; a set meets only its own and the next class."""
    last, parts, low = [], [], 1
    while low <= upto:
        high = int(low / similarity)
        last.append(high)
        parts.append(int(2 * high * (1 - similarity) / (1 + similarity)) + 1)
        low = high + 1
    for _ in range(2):
        high = int((last[-1] + 1) / similarity)
        last.append(high)
        parts.append(int(2 * high * (1 - similarity) / (1 + similarity)) + 1)
    return np.array(last), np.array(parts)


def _meeting_keys(offsets: np.ndarray, values: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) for each token group's content in the set's own size class and the next.

    A class with one token group allows no difference: equal sets are found
    without keys. A group that is empty says nothing, so a set with an empty
    group gets the groups of a further hash as well, as would any partner
    with the same empty group; the eighth keeps its empty groups.
    """
    n = np.diff(offsets)
    last, parts = size_classes(similarity, int(n.max(initial=1)))
    own = np.searchsorted(last, n)
    docs, keys = [], []
    for up in (0, 1):
        level = own + up
        todo = np.flatnonzero((n > 0) & (parts[level] > 1))
        for seed in range(8):
            if not len(todo):
                break
            size = n[todo]
            doc = np.repeat(np.arange(len(todo)), size)
            at = np.repeat(offsets[todo] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            v, g = values[at], parts[level[todo]]
            off = np.cumsum(g) - g
            slot = off[doc] + (mix(v, 11 + seed) % g[doc].astype(_U)).astype(np.int64)
            content = np.zeros(g.sum(), _U)
            np.add.at(content, slot, mix(v, 3))
            count = np.bincount(slot, minlength=g.sum())
            of = np.repeat(np.arange(len(todo)), g)
            name = (np.repeat(level[todo], g) * 8 + seed).astype(_U) * _U(1 << 40) + (np.arange(g.sum()) - off[of]).astype(_U)
            keep = (count > 0) | (seed == 7)
            docs.append(todo[of[keep]])
            keys.append(mix(content[keep] + mix(name[keep], 5)))
            todo = todo[np.unique(of[count == 0])]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(doc, kind="stable")
    return doc[order], key[order]


def _pair_keys(offsets: np.ndarray, values: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(document, key) for each two of the three parts of each token group, in the set's own size class and the next.

    For similarities whose single groups would be too small. Of need groups,
    more than half the differences allowed, some group has one difference at
    most, and so two equal parts. Parts that are both empty say nothing, but
    a group with two filled parts or three has no such two: a set with need
    such groups shares filled parts with every partner. Where partners share
    none, each has such parts only in groups with two differences, fewer than
    need, so both get the groups of a further hash as well; the eighth has
    just need groups and keeps what is empty.
    """
    n = np.diff(offsets)
    last, parts = size_classes(similarity, int(n.max(initial=1)))
    own = np.searchsorted(last, n)
    docs, keys = [], []
    for up in (0, 1):
        level = own + up
        todo = np.flatnonzero((n > 0) & (parts[level] > 1))
        for seed in range(8):
            if not len(todo):
                break
            size, need = n[todo], (parts[level[todo]] - 1) // 2 + 1
            doc = np.repeat(np.arange(len(todo)), size)
            at = np.repeat(offsets[todo] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            v, g = values[at], need + (need // 8 + 1 if seed < 7 else 0)
            off = np.cumsum(g) - g
            slot = 3 * off[doc] + (mix(v, 11 + seed) % (3 * g[doc]).astype(_U)).astype(np.int64)
            content = np.zeros(3 * g.sum(), _U)
            np.add.at(content, slot, mix(v, 3))
            filled = (np.bincount(slot, minlength=len(content)) > 0).reshape(-1, 3)
            of = np.repeat(np.arange(len(todo)), g)
            name = (np.repeat(level[todo], g) * 8 + seed).astype(_U) * _U(1 << 40) + (3 * (np.arange(g.sum()) - off[of])).astype(_U)
            for k, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                keep = filled[:, i] | filled[:, j] | (seed == 7)
                pair = mix(content[i::3][keep], 6) + content[j::3][keep]
                docs.append(todo[of[keep]])
                keys.append(mix(pair + mix(name[keep] + _U(k), 5)))
            todo = todo[np.bincount(of[filled.sum(1) > 1], minlength=len(todo)) < need]
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    doc, key = np.concatenate(docs), np.concatenate(keys)
    order = np.argsort(doc, kind="stable")
    return doc[order], key[order]


def _group(values: np.ndarray) -> np.ndarray:
    """The coordinate that counts each shingle."""
    return (mix(values, 9) % _U(COUNTS)).astype(np.int64)


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _fingerprints(width: int, similarity: Fraction, with_keys: bool, with_sets: bool = True):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            offsets, values = shingle_sets(encoded(b.column("text")), width)
            n = np.diff(offsets)
            total = np.concatenate((np.zeros(1, _U), np.cumsum(mix(values, 1)))), np.concatenate((np.zeros(1, _U), np.cumsum(mix(values, 2))))
            s1, s2 = (t[offsets[1:]] - t[offsets[:-1]] for t in total)
            out = [b.column("id"), pa.array(n), _long(s1), _long(s2)]
            if with_keys:
                doc, key = _meeting_keys(offsets, values, similarity)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n)))))
                out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _long(key)))
                names = ["id", "n", "s1", "s2", "keys"]
            elif not with_sets:
                names = ["id", "n", "s1", "s2"]
            else:
                out.append(pa.array([values[i:j].tobytes() for i, j in zip(offsets, offsets[1:])], pa.binary()))
                at = np.repeat(np.arange(len(n)), n) * COUNTS + _group(values)
                counts = np.bincount(at, minlength=len(n) * COUNTS).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * COUNTS, pa.int32()), pa.array(counts)))
                out.append(b.column("family"))
                names = ["id", "n", "s1", "s2", "shingles", "point", "family"]
                once = np.unique(np.stack((b.column("id").to_numpy(), s1.view(np.int64), s2.view(np.int64)), 1), axis=0, return_index=True)[1]
                yield pa.RecordBatch.from_arrays(out, names).take(pa.array(np.sort(once)))  # a row that is repeated very often comes once a batch
                continue
            yield pa.RecordBatch.from_arrays(out, names)

    return run


def _first_of_each(key: np.ndarray, id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From rows in order of key: whether each is the first of its key, and the id of that first."""
    start = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    return start, id[start][np.cumsum(start) - 1]


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, head): of rows (key, id) that a task has with one key, one stays; the others become edges from its id, dealt out by their own.

    So a key that very many documents share sends a row a task, not one a
    document, to the task that joins it.
    """

    def told(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        key, id = (t.column(c).to_numpy() for c in ("key", "id"))
        order = np.lexsort((id, key))
        key, id = key[order], id[order]
        start, head = _first_of_each(key, id)
        keep = start | (head != id)
        key = np.where(start, key, mix(id.view(_U), 4).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(id[keep]), pa.array(np.where(start, ALONE, head)[keep])], ["key", "id", "head"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= COMBINED:
            yield told(held)
            held, n = [], 0
    if n:
        yield told(held)


def _packed_keys(width: int, similarity: Fraction, names: list[int]):
    """(bucket, ids, counts, keys, edges): the pair keys of many documents by bucket, each as the six bytes that the bucket leaves.

    Of the documents of a chunk that share a key one stays; edges has pairs of
    its id and another's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "text"):
            offsets, values = shingle_sets(encoded(b.column("text")), width)
            doc, key = _pair_keys(offsets, values, similarity)
            ids = b.column("id").to_numpy()
            order = np.lexsort((doc, key))
            doc, key = doc[order], key[order]
            start, head = _first_of_each(key, doc)
            edges = np.unique(np.stack((ids[head[~start]], ids[doc[~start]]), 1), axis=0)
            doc, key = doc[start], key[start]
            bucket = (key % _U(len(names))).astype(np.int64)
            order = np.lexsort((doc, bucket))
            doc, key, bucket = doc[order], (key[order] // _U(len(names))).astype("<u8"), bucket[order]
            new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])))[: len(doc)])
            count = np.diff(np.concatenate((new, [len(doc)])))
            short = key.view(np.uint8).reshape(-1, 8)[:, :6]
            used = np.unique(bucket)
            runs, at = np.searchsorted(bucket[new], [used, used + 1]), np.searchsorted(bucket, [used, used + 1])
            told = [b""] * len(used)
            if len(used):
                told[int(ids[0]) % len(used)] = edges[edges[:, 0] != edges[:, 1]].tobytes()
            cols = [
                pa.array([names[k] for k in used.tolist()], pa.int64()),
                pa.array([ids[doc[new[i:j]]].tobytes() for i, j in runs.T], pa.binary()),
                pa.array([count[i:j].astype(np.uint32).tobytes() for i, j in runs.T], pa.binary()),
                pa.array([short[i:j].tobytes() for i, j in at.T], pa.binary()),
                pa.array(told, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["bucket", "ids", "counts", "keys", "edges"])

    return run


def _unpacked_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id, head) of packed keys; keys of several buckets that share bytes only meet without need."""
    for b in batches:
        for ids, counts, keys, edges in zip(*(b.column(c).to_pylist() for c in ("ids", "counts", "keys", "edges"))):
            key = np.zeros((len(keys) // 6, 8), np.uint8)
            key[:, :6] = np.frombuffer(keys, np.uint8).reshape(-1, 6)
            met = np.frombuffer(edges, np.int64).reshape(-1, 2)
            alone = np.full(len(key), ALONE)
            cols = [key.view("<i8")[:, 0], met[:, 0]], [np.repeat(np.frombuffer(ids, np.int64), np.frombuffer(counts, np.uint32)), met[:, 1]], [alone, met[:, 0]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["key", "id", "head"])


def _met_by_pairs(source: DataFrame, prints: DataFrame, same: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """(key, id, head) in partitions by key, without documents that are copies of others throughout."""
    spark = source.sparkSession
    copies = written(prints.where("n > 0 AND id IS NOT NULL").select("id").distinct().join(same.select("id").distinct(), "id", "left_anti"), "copies")
    few = copies.count() <= BROADCAST_IDS
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = spark.range(64 * parts).selectExpr("id", f"pmod(hash(id), {parts}) AS p").groupBy("p").agg(F.min("id").alias("id"))
    names = [r["id"] for r in at.collect()]  # a bucket for each partition
    once = source.where("id IS NOT NULL").join(F.broadcast(copies) if few else copies, "id", "left_anti").select("id", "text")
    dealt = once.mapInArrow(_packed_keys(width, similarity, names), "bucket long, ids binary, counts binary, keys binary, edges binary").repartition(parts, "bucket")
    return dealt.mapInArrow(_unpacked_keys, "key long, id long, head long")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, id): an edge from the first of each key to each other, and the edges that rows carry."""
    key, lead = None, None
    for b in batches:
        k, v, head = (b.column(c).to_numpy() for c in ("key", "id", "head"))
        met = head != ALONE
        if met.any():
            yield pa.RecordBatch.from_arrays([pa.array(head[met]), pa.array(v[met])], ["u", "v"])
            k, v = k[~met], v[~met]
        if not len(k):
            continue
        start, first = _first_of_each(k, v)
        if k[0] == key:
            first = np.where(np.cumsum(start) == 1, lead, first)
            start[0] = False
        key, lead = k[-1], first[-1]
        keep = ~start & (first != v)
        yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(v[keep])], ["u", "v"])


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of each point of a with each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for g in range(a.shape[1]):
        out += np.minimum(a[:, g, None], b[None, :, g])
    return out


def leaves(points: np.ndarray, size: int = LEAF) -> tuple[list[np.ndarray], np.ndarray]:
    """Sort-tile packing: members of each leaf, and the leaves' upper corners."""
    total = points.sum(1)
    order = np.argsort(total, kind="stable")
    slab = max(size, int(np.ceil(np.sqrt(len(order) / size))) * size)
    packed = []
    for i in range(0, len(order), slab):
        part = order[i : i + slab]
        part = part[np.argsort(points[part, 0], kind="stable")]
        packed += [np.sort(part[j : j + size]) for j in range(0, len(part), size)]
    return packed, np.array([points[m].max(0) for m in packed])


def _alike(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return common * similarity.denominator >= (len(a) + len(b) - common) * similarity.numerator


def links(ids: np.ndarray, sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, similarity: Fraction) -> list[tuple[int, int]]:
    """Verified links that join different labels, as many as it takes to connect what links.

    side: 0 and 1 for the two blocks of a pair, which need no comparison
    within themselves; 2 throughout for a block with itself.
    """
    order = np.lexsort((ids, [len(s) for s in sets]))
    ids, sets, side = ids[order], [sets[i] for i in order], side[order]
    label = np.unique(label[order], return_inverse=True)[1]
    n = np.array([len(s) for s in sets])
    points = np.array([np.bincount(_group(s), minlength=COUNTS) for s in sets]).reshape(len(sets), COUNTS)
    num, both = similarity.numerator, similarity.numerator + similarity.denominator
    packed, corner = leaves(points)
    low = np.array([n[m].min() for m in packed])
    near = overlap_bound(corner, corner) * both >= num * (low[:, None] + low[None, :])
    out = []
    for i, rows in enumerate(packed):
        for j in np.flatnonzero(near[i, i:]) + i:
            cols = packed[j]
            ok = overlap_bound(points[rows], points[cols]) * both >= num * (n[rows][:, None] + n[cols][None, :])
            ok &= (side[rows][:, None] != side[cols][None, :]) | (side[rows][:, None] == 2)
            for r, x in enumerate(rows):
                for y in cols[ok[r] & (label[cols] != label[x])]:
                    if label[x] != label[y] and _alike(sets[x], sets[y], similarity):
                        out.append((int(ids[x]), int(ids[y])))
                        label[label == label[y]] = label[x]
    return out


def _block_links(similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["family", "i", "j"]):
            sets = [np.frombuffer(s, _U) for s in t.column("shingles").to_pylist()]
            found = links(*(t.column("id").to_numpy(), sets, t.column("label").to_numpy(), t.column("side").to_numpy()), similarity)
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], ["u", "v"])

    return run


def _fine_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles as counts of finer groups, at least one for every FINE shingles; their number is a power of two, so that halves of a longer point add up to a shorter one."""
    for b in batches:
        fine = []
        for s in b.column("shingles").to_pylist():
            v = np.frombuffer(s, _U)
            n = max(COUNTS, 1 << (-(-len(v) // FINE) - 1).bit_length())
            fine.append(np.bincount((mix(v, 9) % _U(n)).astype(np.int64), minlength=n).astype("<u4").tobytes())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "s1", "s2")), pa.array(fine, pa.binary())], ["id", "s1", "s2", "fine"])


def partners(points: list[np.ndarray], label: np.ndarray, side: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Which points have another of a different label, of the other side unless side is 2, whose summed minima allow a link."""
    n, both, num = np.array([int(p.sum()) for p in points]), similarity.numerator + similarity.denominator, similarity.numerator
    fold = lambda size: np.array([p.reshape(-1, size).sum(0) for p in points], np.int32).reshape(len(points), size)
    coarse, size = fold(COUNTS), min(map(len, points))
    fine, found = coarse if size == COUNTS else fold(size), np.zeros(len(points), bool)
    for a in range(0, len(points), ROWS):
        r = slice(a, a + ROWS)
        ok = (label[r, None] != label[None, :]) & ((side[r, None] != side[None, :]) | (side[r, None] == 2))
        ok &= overlap_bound(coarse[r], coarse) * both >= num * (n[r, None] + n[None, :])
        i, j = np.nonzero(ok)
        i += a
        for k in range(0, len(i), step := max(1, 2_000_000 // size)):
            x, y = i[k : k + step], j[k : k + step]
            found[x[np.minimum(fine[x], fine[y]).sum(1) * both >= num * (n[x] + n[y])]] = True
    return found


def _with_partners(similarity: Fraction):
    names = ["family", "i", "j", "side", "label", "id", "s1", "s2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["family", "i", "j"]):
            points = [np.frombuffer(f, "<u4") for f in t.column("fine").to_pylist()]
            left = partners(points, t.column("label").to_numpy(), t.column("side").to_numpy(), similarity)
            yield from t.select(names).filter(pa.array(left)).combine_chunks().to_batches()

    return run


def _compared(sets: DataFrame, rows: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (u, v) found in blocks: rows have family, i, j, side, label, and the set as id, s1, s2.

    Finer counts are dealt to the pairs of blocks first; a set is dealt only
    to those where they leave it a partner.
    """
    by, of = ["family", "i", "j"], ["id", "s1", "s2"]
    fine = sets.select(*of, "shingles").mapInArrow(_fine_counts, "id long, s1 long, s2 long, fine binary").join(rows, of)
    dealt = fine.select(*by, "side", "label", *of, "fine").repartition(*by).sortWithinPartitions(*by)
    kind = "family long, i long, j long, side int, label long, id long, s1 long, s2 long"
    left = written(dealt.mapInArrow(_with_partners(similarity), kind), "partners")
    some = F.broadcast(left) if left.count() <= BROADCAST_ROWS else left
    dealt = sets.select(*of, "shingles").join(some, of).select(*by, "side", "label", "id", "shingles").repartition(*by).sortWithinPartitions(*by)
    return written(dealt.mapInArrow(_block_links(similarity), "u long, v long"), "links")


def _weights(most_sets: int, most_shingles: int):
    """Adds upto and base to rows sorted by family and the rest, each once.

    upto is the weight of the family's sets before it in this partition, of
    which most_shingles fill a block and most_sets weigh as much at most; base
    is the family's first block, from partition << 32 on, if it begins here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = -(-most_shingles // most_sets)
        base, family, last, upto = TaskContext.get().partitionId() << 32, None, None, 0
        for b in batches:
            keep, out = [], []
            for i, (f, n, *row) in enumerate(zip(*(b.column(c).to_pylist() for c in ("family", "n", "id", "s1", "s2")))):
                if row == last:
                    continue
                last = row
                if f != family:
                    base, family, upto = base + -(-upto // most_shingles), f, 0
                keep.append(i)
                out.append((base, upto))
                upto += min(max(least, n), most_shingles)
            kept = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.int64())], [*b.schema.names, "base", "upto"])

    return run


def _placed(rows: DataFrame, most_sets: int, most_shingles: int) -> DataFrame:
    """rows (family, n, point, id, s1, s2), each once, with the block of their family that they are in.

    A family's blocks are cut in order of size and counts, wherever the ranges
    end that it is dealt to: more tasks make no more blocks.
    """
    order = ["family", "n", "point", "id", "s1", "s2"]
    x = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)  # without the sets themselves
    x = written(x.mapInArrow(_weights(most_sets, most_shingles), "family long, n long, point array<int>, id long, s1 long, s2 long, base long, upto long"), "placed")
    weight = f"least(greatest(n, {-(-most_shingles // most_sets)}), {most_shingles})"
    each = x.groupBy("family", "base").agg(F.expr(f"max(upto + {weight})").alias("total"))
    begun = each.selectExpr("family", "base", "min(base) OVER (PARTITION BY family) AS first", "sum(total) OVER (PARTITION BY family ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start")
    begun = written(begun.where("start IS NOT NULL"), "begun")  # families that go on from another range: one a range at most
    x = x.join(F.broadcast(begun), ["family", "base"], "left")
    return x.selectExpr(*order, f"coalesce(first, base) + (coalesce(start, 0) + upto) div {most_shingles} AS block")


def _nodes(below: DataFrame, *by) -> DataFrame:
    """Nodes of a tree from those below them: sizes, upper corner, and range of labels."""
    corner = F.array(*[F.max(F.col("corner")[g]) for g in range(COUNTS)]).alias("corner")
    return below.groupBy("family", *by).agg(F.min("low").alias("low"), F.max("high").alias("high"), corner, F.min("a").alias("a"), F.max("b").alias("b"))


def _may_link(similarity: Fraction) -> str:
    """SQL: whether something below node x can link with something below node y that it is not connected with."""
    num, den = similarity.numerator, similarity.denominator
    overlap = "aggregate(zip_with(x.corner, y.corner, (p, q) -> least(p, q)), 0L, (s, c) -> s + c)"
    sizes = f"x.low * {num} <= y.high * {den} AND y.low * {num} <= x.high * {den}"
    return f"{sizes} AND NOT (x.a = x.b AND y.a = y.b AND x.a = y.a) AND {overlap} * {num + den} >= {num} * (x.low + y.low)"


def tree_pairs(leaves: DataFrame, similarity: Fraction) -> DataFrame:
    """(family, i, j), i < j: pairs of blocks that the join of the families' trees with themselves leaves.

    leaves: family, block, low, high, corner, a, b. Top nodes meet by
    band of sizes; below, nodes meet where their parents did.
    """
    ok = _may_link(similarity)
    blocks = leaves.withColumn("inner", F.expr(f"block div {FAN_OUT}"))
    inner = _nodes(blocks, "inner").withColumn("top", F.expr(f"shiftright(inner * {FAN_OUT}, 32)"))
    top = _nodes(inner, "top")
    band = lambda n: f"CAST(floor(ln({n}) / ln({similarity.denominator} / {similarity.numerator}D)) AS INT)"
    x = top.selectExpr("*", f"explode(sequence({band('low')}, {band('high')})) AS band").alias("x")
    y = top.selectExpr("*", f"explode(sequence({band('low')} - 1, {band('high')} + 1)) AS band").alias("y")
    met = x.join(y, F.expr(f"x.family = y.family AND x.band = y.band AND {ok}")).select("x.family", F.least("x.top", "y.top").alias("i"), F.greatest("x.top", "y.top").alias("j")).distinct()
    for nodes, up, name in ((inner, "top", "inner"), (blocks, "inner", "block")):
        x, y = nodes.alias("x"), nodes.alias("y")
        below = met.alias("m").join(x, F.expr(f"m.family = x.family AND m.i = x.{up}")).join(y, F.expr(f"m.family = y.family AND m.j = y.{up} AND x.{name} <= y.{name} AND {ok}"))
        met = below.selectExpr("m.family AS family", f"x.{name} AS i", f"y.{name} AS j")
    return met.where("i < j")


def _rounds(pairs: DataFrame, placed: DataFrame) -> int:
    """Rounds in which the sets of pairs of blocks are dealt out, so that each deals about DEALT times the sets there are at most."""
    sets = placed.groupBy("block").agg(F.count("*").alias("sets"))
    ends = pairs.selectExpr("i AS block").union(pairs.selectExpr("j AS block"))
    dealt = ends.join(sets, "block").agg(F.sum("sets")).first()[0] or 0
    return max(1, -(-dealt // (DEALT * max(1, placed.count()))))


def _further(sets: DataFrame, placed: DataFrame, many: DataFrame, parts: DataFrame, similarity: Fraction) -> DataFrame:
    """Links (u, v) with those between blocks that are no neighbours, where a family is in several of the components parts (id, c) of its neighbours' links.

    Pairs of blocks may grow with the square of a family's, so they are dealt
    out in rounds of bounded size. What a round connects, later ones leave out.
    """
    rounds, pairs, at, edges = None, None, 0, parts.toDF("u", "v")
    while rounds is None or at < rounds:
        rows = placed.join(many.select("block", "next"), "block").join(parts, "id", "left").withColumn("label", F.coalesce("c", "id"))
        labels = written(rows.select("id", "block", "label"), "labels")
        leaves = many.join(labels.groupBy("block").agg(F.min("label").alias("a"), F.max("label").alias("b")), "block")
        split = leaves.groupBy("family").agg(F.min("a").alias("least"), F.max("b").alias("most")).where("least <> most").select("family")
        leaves = written(leaves.join(split, "family", "left_semi"), "leaves")
        if leaves.isEmpty():
            break
        if pairs is None:
            pairs = tree_pairs(leaves.drop("next"), similarity).join(leaves.select(F.col("block").alias("i"), "next"), "i").where("NOT j <=> next")
            pairs = written(pairs.select("i", "j"), "pairs")
            rounds = _rounds(pairs, placed)
        some = pairs.where(F.pmod(F.xxhash64("i", "j"), F.lit(rounds)) == at) if rounds > 1 else pairs
        if at:
            ends = leaves.select("block", "a", "b")
            some = some.join(ends.toDF("i", "_a", "_b"), "i").join(ends.toDF("j", "_c", "_d"), "j").where("NOT (_a = _b AND _c = _d AND _a = _c)").select("i", "j")
        ends = some.selectExpr("i AS block", "i", "j", "0 AS side").union(some.selectExpr("j AS block", "i", "j", "1 AS side"))
        rows = placed.select("id", "s1", "s2", "block", "family").join(labels.select("id", "block", "label").distinct(), ["id", "block"]).join(ends, "block")
        edges = parts.toDF("u", "v").union(_compared(sets, rows.drop("block"), similarity))
        at += 1
        if at < rounds:
            parts = components(edges).selectExpr("v AS id", "c")
    return edges


def components_by_similarity(df: DataFrame, id: str = "doc_id", text: str = "text", width: int = 3, similarity: Fraction = Fraction(9, 10)) -> DataFrame:
    """(id, n_shingles, component_id) for every row of df.

    A text's set holds its distinct shingles of width lower-cased words; sets
    link when their Jaccard similarity is at least similarity. component_id is
    the smallest id reachable by links. Null and empty texts have empty sets
    and are linked with nothing. Rows that repeat an id are one document with
    several texts; rows without an id have a null component. Other columns are
    ignored, whatever their names; an empty table gives no rows. The tables
    that this takes, of about the size of the texts, are gone when it returns.
    """
    with scratch():
        return written(_by_similarity(df, id, text, width, similarity), "components", beyond=True)


def _by_similarity(df: DataFrame, id: str, text: str, width: int, similarity: Fraction) -> DataFrame:
    source = df.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    single = similarity >= SINGLE_GROUPS
    prints = source.mapInArrow(_fingerprints(width, similarity, single, False), "id long, n long, s1 long, s2 long" + ", keys array<long>" * single)
    prints = written(prints, "prints")
    whole = prints.where("n > 0 AND id IS NOT NULL")
    same = whole.groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.max("id").alias("last"), *[F.first("keys").alias("keys")] * single)
    same = written(same, "classes")
    if single:
        keys = same.selectExpr("explode(keys) AS key", "id").mapInArrow(_combined, "key long, id long, head long").repartition("key")
    else:
        keys = _met_by_pairs(source, prints, same, width, similarity)
    met = keys.sortWithinPartitions("key", "id").mapInArrow(_meetings, "u long, v long")
    family = written(components(met).selectExpr("v AS id", "c AS family"), "families")
    small = (lambda x: F.broadcast(x)) if family.count() <= BROADCAST_IDS else (lambda x: x)
    kind = "id long, n long, s1 long, s2 long, shingles binary, point array<int>, family long"
    sets = source.join(small(family), "id").select("id", "text", "family").mapInArrow(_fingerprints(width, similarity, False), kind).where("n > 0")
    sets = written(sets, "sets")
    placed = _placed(sets, BLOCK_SETS, BLOCK_SHINGLES)
    corner = F.array(*[F.max(F.col("point")[g]) for g in range(COUNTS)]).alias("corner")
    leaves = placed.groupBy("family", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), corner)
    at = "OVER (PARTITION BY family ORDER BY block)"  # one small row a block
    many = written(leaves.selectExpr("*", f"lead(block) {at} AS next", f"lag(block) {at} AS before").where("next IS NOT NULL OR before IS NOT NULL"), "blocks")
    trio = "array(named_struct('i', block, 'j', block, 'side', 2), named_struct('i', block, 'j', next, 'side', 0), named_struct('i', before, 'j', block, 'side', 1))"
    near = placed.select("id", "s1", "s2", "family", "block").join(many.select("block", "next", "before"), "block", "left")
    near = near.selectExpr("id", "s1", "s2", "family", "id AS label", f"explode(filter({trio}, p -> p.i IS NOT NULL AND p.j IS NOT NULL)) AS p")
    found = _compared(sets, near.select("id", "s1", "s2", "family", "label", "p.i", "p.j", "p.side"), similarity)
    if not many.isEmpty():
        parts = components(found).selectExpr("v AS id", "c")
        found = _further(sets, placed, many.drop("before"), parts, similarity)
    joined = components(found.union(same.where("id <> last").selectExpr("id AS u", "id AS v")))
    moved = same.join(joined.selectExpr("v AS id", "c"), "id", "left").where("c <> id OR last <> id").selectExpr("s1", "s2", "n", "coalesce(c, id) AS c")
    out = prints.select("id", "n", "s1", "s2").join(moved, ["s1", "s2", "n"], "left")
    return out.selectExpr("id", "n AS n_shingles", "if(id IS NULL, NULL, coalesce(c, id)) AS component_id")


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    return components_by_similarity(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] END AS s FROM places),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
    SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
arcs AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT DISTINCT x AS v, x AS r FROM arcs UNION SELECT arcs.y, reach.r FROM reach JOIN arcs ON reach.v = arcs.x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN (SELECT v, min(r) AS r FROM reach GROUP BY v) m ON d.doc_id = m.v
"""
