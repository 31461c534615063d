"""Edits from differences: the ops that turn a list into a wanted one.

Small lists are compared in a task, with as few ops as there can be. Of large
ones, elements that occur once on both sides are joined; of these a longest
increasing subsequence stays, found over whole runs that were moved together,
and parts both sides into gaps, in which the same is done again. What is left
is small gaps, compared like small lists, and such as have no element of their
own, which are cut into pieces first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import scans
from tidelog.shared import few, kept

#: Elements of one side that a task compares at once; runs of anchors that it puts in order.
MOST, MOST_RUNS = 4096, 1_000_000
#: Lengths of the factors that are looked for, round by round.
WIDTHS = (1, 1, 4)


def common(old: list, new: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence: a row of bits an element of new, from which the way back is read."""
    start, end = 0, 0
    while start < min(len(old), len(new)) and old[start] == new[start]:
        start += 1
    while end < min(len(old), len(new)) - start and old[-1 - end] == new[-1 - end]:
        end += 1
    a, b = old[start : len(old) - end], new[start : len(new) - end]
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    rows = [row]
    for y in b:
        u = row & masks.get(y, 0)
        row = ((row + u) | (row - u)) & full
        rows.append(row)
    i, j, middle = len(a) - 1, len(b), []
    while i >= 0 and j > 0:
        if rows[j] >> i & 1:
            i -= 1
        elif rows[j - 1] >> i & 1:
            middle.append((start + i, start + j - 1))
            i, j = i - 1, j - 1
        else:
            j -= 1
    return [(k, k) for k in range(start)] + middle[::-1] + [(len(old) - k, len(new) - k) for k in range(end, 0, -1)]


def heaviest(starts: list[int], sizes: list[int]) -> list[int]:
    """Of runs in order, with the place that each starts at on the other side, those of an increasing subsequence of most elements."""
    tops: list[int] = []  # starts at which the best weight so far grows, and that weight
    weights: list[int] = []
    ends: list[int] = []
    before = [-1] * len(starts)
    for k, (s, n) in enumerate(zip(starts, sizes)):
        i = bisect_left(tops, s)
        before[k] = ends[i - 1] if i else -1
        w = n + (weights[i - 1] if i else 0)
        j = i
        while j < len(tops) and weights[j] <= w:
            j += 1
        tops[i:j], weights[i:j], ends[i:j] = [s], [w], [k]
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(k)
        k = before[k]
    return out[::-1]


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few(batches):
        out = []
        for object, ops, old, new in zip(*(b.column(c).to_pylist() for c in ("object", "ops", "old", "new"))):
            n, a, kept = 0, 0, [*common(old, new), (len(old), len(new))]
            for j, y in enumerate(new):
                if j == kept[a][1]:
                    a += 1
                    continue
                n += 1
                follows = j > 0 and (a == 0 or kept[a - 1][1] != j - 1)
                out.append((object, n, None if follows else ops[kept[a - 1][0]] if a else 0, y))
            stay = {i for i, _ in kept}
            out += [(object, None, o, None) for i, o in enumerate(ops) if i not in stay]
        names = ["object", "n", "ref", "value"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names)


def _in_a_task(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(object, n, ref, value): removals of ref, and the n-th insert, after ref or (null) the insert before it."""
    old = current.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("pos", "op", "value"))).alias("a"))
    new = wanted.groupBy("object").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("b"))
    none = F.array().cast("array<string>")
    both = old.join(new, "object", "full").select("object", F.coalesce("a.op", F.array().cast("array<bigint>")).alias("ops"), F.coalesce("a.value", none).alias("old"), F.coalesce("b.value", none).alias("new"))
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).mapInArrow(_small, "object long, n long, ref long, value string")


def _hash(value: Column) -> Column:
    """Half of a value's SHA-256, as bytes."""
    return F.substring(F.unhex(F.sha2(value, 256)), 1, 16)


def _factors(lines: DataFrame, width: int) -> DataFrame:
    """lines with hash over width elements from each on, of one gap; those that reach over its end have none."""
    step = 1
    while step < width:
        ahead = lines.select("object", "side", "gap", (F.col("i") - step).alias("i"), F.col("hash").alias("_next"))
        lines = lines.join(ahead, ["object", "side", "gap", "i"]).withColumn("hash", _hash(F.concat("hash", "_next"))).drop("_next")
        step *= 2
    return lines


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kept = []
        for runs in b.column("runs").to_pylist():
            stay = heaviest([r["start"] for r in runs], [r["n"] for r in runs])
            kept.append([runs[k]["run"] for k in stay])
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("object", "gap", "band")), pa.array(kept, pa.list_(pa.int64()))], ["object", "gap", "band", "kept"])


def _anchors(lines: DataFrame, width: int, most_runs: int) -> DataFrame:
    """(object, old, new): places of elements that begin a factor which its gap has once on both sides, in the same order on both."""
    is_old, i = F.col("side") == 0, F.col("i")
    x = _factors(lines, width).groupBy("object", "gap", "hash").agg(
        F.count(F.when(is_old, 1)).alias("a"), F.count(F.when(~is_old, 1)).alias("b"), F.max(F.when(is_old, i)).alias("old"), F.max(F.when(~is_old, i)).alias("new")
    ).where("a = 1 AND b = 1").select("object", "gap", "old", "new")
    key = ["object", "gap"]
    x = scans.numbered(x, key, ["new"], "place")
    x = scans.scanned(x, key, ["old"], sums={"rank": F.lit(1).cast("long")}, before={"_last": F.col("place")}).withColumn("rank", F.col("rank") - 1)
    x = scans.scanned(x.select(*key, "old", "new", "place", "rank", F.when(F.col("place") == F.col("_last") + 1, 0).otherwise(1).alias("_new")), key, ["old"], sums={"run": F.col("_new")}).drop("_new")
    runs = x.groupBy(*key, "run").agg(F.min("place").alias("start"), F.min("rank").alias("rank"), F.count("*").alias("n"))
    total = runs.groupBy(*key).agg(F.count("*").alias("runs"), F.sum("n").alias("all"))
    # more runs than a task takes: only those that stand in the same part of both sides can stay
    bands = F.ceil(F.col("runs") / most_runs)
    band = lambda c: F.floor(c * bands / F.col("all"))
    runs = runs.join(total, key).withColumn("band", band(F.col("rank"))).where(F.col("band") == band(F.col("start"))).where((bands == 1) | (band(F.col("rank") + F.col("n") - 1) == F.col("band")) & (band(F.col("start") + F.col("n") - 1) == F.col("band")))
    per = runs.groupBy(*key, "band").agg(F.sort_array(F.collect_list(F.struct("run", "start", "n"))).alias("runs"))
    kept = per.mapInArrow(_ordered, "object long, gap long, band long, kept array<long>").select(*key, F.explode("kept").alias("run"))
    return x.join(kept, [*key, "run"]).select("object", "old", "new")


def _gaps(lines: DataFrame, anchors: DataFrame) -> DataFrame:
    """lines that are no anchors, with the gap they are in: the old place of the nearest anchor before, and one more, 0 before the first. lines have the gaps of earlier anchors."""
    both = anchors.select("object", F.lit(0).alias("side"), F.col("old").alias("i"), "old").unionByName(anchors.select("object", F.lit(1).alias("side"), F.col("new").alias("i"), "old"))
    x = scans.scanned(lines.join(both, ["object", "side", "i"], "left"), ["object", "side"], ["i"], lasts={"_gap": F.col("old")})
    return x.where("old IS NULL").select("object", "side", "i", "hash", F.greatest("gap", F.coalesce("_gap", F.lit(-1)) + 1).alias("gap"))


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few(batches):
        out: list[list[dict]] = []
        for old, new in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
            pairs = common([x["hash"] for x in old], [x["hash"] for x in new])
            out.append([{"old": old[i]["i"], "new": new[j]["i"]} for i, j in pairs])
        kind = pa.list_(pa.struct([("old", pa.int64()), ("new", pa.int64())]))
        yield pa.RecordBatch.from_arrays([b.column("object"), pa.array(out, kind)], ["object", "pairs"])


def _compared(lines: DataFrame, most: int) -> DataFrame:
    """(object, old, new): longest common subsequences of gaps; larger gaps are cut into pieces, as many on both sides."""
    is_old = F.col("side") == 0
    sizes = lines.groupBy("object", "gap").agg(F.count(F.when(is_old, 1)).alias("a"), F.count(F.when(~is_old, 1)).alias("b"), F.min(F.when(is_old, F.col("i"))).alias("first_a"), F.min(F.when(~is_old, F.col("i"))).alias("first_b")).where("a > 0 AND b > 0")
    n, first = F.when(is_old, F.col("a")).otherwise(F.col("b")), F.when(is_old, F.col("first_a")).otherwise(F.col("first_b"))
    pieces = F.ceil(F.greatest("a", "b") / most)
    x = lines.join(sizes, ["object", "gap"]).withColumn("piece", F.floor((F.col("i") - first) * pieces / n))
    each = lambda side: F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("i", "hash"))))
    per = x.groupBy("object", "gap", "piece").agg(each(0).alias("a"), each(1).alias("b")).where("size(a) > 0 AND size(b) > 0")
    return per.mapInArrow(_matched, "object long, pairs array<struct<old: long, new: long>>").select("object", F.explode("pairs").alias("p")).select("object", "p.old", "p.new")


def _by_joins(current: DataFrame, wanted: DataFrame, most: int, most_runs: int) -> DataFrame:
    """As _in_a_task, of lists of any size; values meet their places at the end, before that hashes stand for them."""
    hash = _hash(F.coalesce(F.concat(F.lit("="), "value"), F.lit(""))).alias("hash")
    old = kept(scans.numbered(current.select("object", "pos", "op", hash), ["object"], ["pos"]).select("object", "i", "op", "hash"))
    new = kept(scans.numbered(wanted.select("object", "pos", hash), ["object"], ["pos"]).select("object", "i", "pos", "hash"))
    side = lambda x, n: x.select("object", F.lit(n).alias("side"), "i", "hash", F.lit(0).cast("long").alias("gap"))
    lines, found = side(old, 0).unionByName(side(new, 1)), None
    for width in WIDTHS:
        more = kept(_anchors(lines, width, most_runs))
        if more.isEmpty():
            continue
        found = more if found is None else found.unionByName(more)
        lines = kept(_gaps(lines, more))
    rest = _compared(lines, most)
    pairs = kept(rest if found is None else found.unionByName(rest))
    gone = old.join(pairs.select("object", F.col("old").alias("i")), ["object", "i"], "left_anti").select("object", F.lit(None).cast("long").alias("n"), F.col("op").alias("ref"), F.lit(None).cast("string").alias("value"))
    named = pairs.join(old.select("object", F.col("i").alias("old"), "op"), ["object", "old"]).select("object", F.col("new").alias("i"), "op")
    x = scans.scanned(new.drop("hash").join(named, ["object", "i"], "left"), ["object"], ["i"], sums={"n": F.col("op").isNull().cast("long")}, before={"_last": F.struct("op")})
    ref = F.when(F.col("_last").isNull(), F.lit(0).cast("long")).otherwise(F.col("_last.op"))
    told = x.where("op IS NULL").select("object", "pos", "n", ref.alias("ref")).join(wanted.select("object", "pos", "value"), ["object", "pos"])
    return told.select("object", "n", "ref", "value").unionByName(gone)


def edited(current: DataFrame, wanted: DataFrame, base: Column, most: int = MOST, most_runs: int = MOST_RUNS) -> DataFrame:
    """(object, op, ref, value) ops that turn the alive list current (object, pos, op, value) into wanted (object, pos, value).

    A null value removes the vertex ref, with the event base; others are
    inserted after ref with the events base + 1 and on, each of a run after
    the one before. Objects on one side only are emptied or made. Equal lists
    give no ops. Lists of up to most elements on both sides are compared in a
    task each and get the fewest ops; larger ones are compared by joins, and
    tasks hold most elements of a side, or most_runs moved runs.
    """
    sizes = current.select("object", F.lit(0).alias("side")).unionByName(wanted.select("object", F.lit(1).alias("side"))).groupBy("object", "side").count()
    big = sizes.where(F.col("count") > most).select("object").distinct().persist()
    if big.isEmpty():
        x = _in_a_task(current, wanted)
    else:
        small = [y.join(big, "object", "left_anti") for y in (current, wanted)]
        large = [y.join(big, "object", "left_semi") for y in (current, wanted)]
        x = _in_a_task(*small).unionByName(_by_joins(*large, most, most_runs))
    return x.select("object", F.when(F.col("n").isNull(), base).otherwise(base + F.col("n")).alias("op"), F.coalesce("ref", base + F.col("n") - 1).alias("ref"), "value")
