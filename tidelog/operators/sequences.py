"""Ordered reducers: replicated lists, causal trees and grow-only trees.

Marks (tombstones, deletions) are plain aggregates and joins. Only the order
of one object's elements needs its rows together; that step runs per object.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.shared import few, kept


def tombstones(removals: DataFrame, key: list[str], target: str, tombstone: str) -> DataFrame:
    """The greatest tombstone of each target."""
    return removals.groupBy(*key, target).agg(F.max(tombstone).alias(tombstone))


def marked(vertices: DataFrame, removals: DataFrame, key: list[str], op: str, target: str, tombstone: str) -> DataFrame:
    """Vertices with ref: 0, or the greatest tombstone that targets them."""
    t = tombstones(removals, key, target, tombstone).withColumnRenamed(target, op).withColumnRenamed(tombstone, "ref")
    return vertices.join(t, [*key, op], "left").withColumn("ref", F.coalesce("ref", F.lit(0).cast("long")))


def descending_merge(states: list[DataFrame], key: list[str], op: str, payload: str) -> DataFrame:
    """Lists that each stand in descending id order, merged: equal ids unify, pos is the place from 0."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    once = rows.groupBy(*key, op).agg(F.max(payload).alias(payload))
    by = ", ".join(key)
    return once.withColumn("pos", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {op} DESC) - 1"))


def _walk(ops: list[int], parents: list[int]) -> list[int]:
    """Ids in pre-order from the root 0, siblings by descending id; what is not reachable is left out."""
    below = defaultdict(list)
    for o, p in zip(ops, parents):
        below[p].append(o)
    out, stack = [], sorted(below[0])
    while stack:
        o = stack.pop()
        out.append(o)
        stack += sorted(below.get(o, ()))
    return out


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few(batches):
        ops, parents = ([x.values.to_numpy().tolist() for x in b.column(c)] for c in ("ops", "parents"))
        yield pa.RecordBatch.from_arrays([b.column("object"), pa.array(map(_walk, ops, parents), pa.list_(pa.int64()))], ["object", "ops"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each step's end and distance, of steps (at, to, n) that are all here, by pointer doubling."""
    steps = pa.Table.from_batches([*batches], pa.schema([("at", pa.int64()), ("to", pa.int64()), ("n", pa.int64())]))
    at, to, n = (steps.column(c).to_numpy() for c in ("at", "to", "n"))
    order = np.argsort(at)
    at, to, n = at[order], to[order], n[order].copy()
    for _ in range(64):
        if (to < 0).all():
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, to, n)], ["at", "to", "n"])
            return
        here = np.flatnonzero(to >= 0)
        ahead = np.searchsorted(at, to[here])
        to[here], n[here] = to[ahead], n[here] + n[ahead]
    raise ValueError("a tree has a cycle")


def _distances(steps: DataFrame, local: int, most: int = 256) -> DataFrame:
    """(at, to, n) of each step with to its end (less than zero) and n the distance to it.

    Every round drops about a quarter of the steps, those after a step that is
    not dropped by the same toss; the step before one takes over what it leads
    to. The last local steps are done in one task, and then the rounds are gone
    through backwards. So all rounds together move a few times the steps,
    whatever the length of the tours.
    """
    x, gone = kept(steps), []
    for k in range(most):
        left = x.count()
        if left <= local:
            break
        toss = lambda c: F.col(c).isNotNull() & (F.col(c) >= 0) & (F.pmod(F.xxhash64(c, F.lit(k)), F.lit(2)) == 1)  # noqa: B023,E731
        pair = (~toss("at")) & toss("to")
        by = x.where(pair).select("at", F.col("to").alias("via"), "n")
        ahead = x.where(toss("at")).select(F.col("at").alias("via"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        met = kept(by.join(ahead, "via", "full"))
        gone.append(met.where("at IS NOT NULL").select(F.col("via").alias("at"), F.col("_to").alias("to"), F.col("_n").alias("n")))
        after = met.where("at IS NOT NULL").select("at", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"))
        x = kept(x.where(~pair & ~toss("at")).unionByName(after).unionByName(met.where("at IS NULL").select(F.col("via").alias("at"), F.col("_to").alias("to"), F.col("_n").alias("n"))))
    else:
        raise ValueError("a tree has a cycle")
    found = kept(x.coalesce(1).mapInArrow(_ends, "at long, to long, n long"))
    for x in gone[::-1]:
        on = found.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        found = found.unionByName(kept(x.join(on, "to", "left").select("at", F.coalesce("_to", "to").alias("to"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))))
    return found


def _ranked(nodes: DataFrame, local: int = 500_000) -> DataFrame:
    """(object, root, op, pos) of trees of any size by list ranking: the tour of a tree, and each step's distance to its end.

    A tour enters a node, goes to its greatest child or leaves it, and from
    there to its next smaller sibling or leaves the parent. Every round is an
    equi-join, so a tree with a third of all rows is as spread as the others.
    root is the parent at the top that is no node itself; places are counted
    for each root. Nodes are numbered first, and steps are numbers alone.
    """
    x = kept(nodes.select("object", "op", "parent", F.monotonically_increasing_id().alias("id")))
    among = Window.partitionBy("object", "parent").orderBy(F.desc("op"))
    x = x.withColumn("sibling", F.lead("id").over(among)).withColumn("eldest", F.row_number().over(among) == 1)
    x = x.join(x.select("object", F.col("op").alias("parent"), F.col("id").alias("up")), ["object", "parent"], "left")
    x = kept(x.select("object", "op", "parent", "id", "sibling", "eldest", "up"))
    enter, leave = (lambda c: 2 * F.col(c)), (lambda c: 2 * F.col(c) + 1)
    child = x.where("eldest AND up IS NOT NULL").select(F.col("up").alias("id"), F.col("id").alias("child"))
    after = F.when(F.col("sibling").isNotNull(), enter("sibling")).when(F.col("up").isNotNull(), leave("up")).otherwise(-1 - F.col("id"))
    y = x.select("id", after.alias("after")).join(child, "id", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = F.array(F.struct(enter("id").alias("at"), F.coalesce(enter("child"), F.col("after")).alias("to"), one.alias("n")), F.struct(F.when(F.col("child").isNotNull(), leave("id")).alias("at"), F.col("after").alias("to"), none.alias("n")))
    steps = y.select(F.inline(both)).where("at IS NOT NULL")  # a node without children is left as it is entered
    ends = kept(_distances(steps, local).where("at % 2 = 0").select(F.expr("at div 2").alias("id"), F.col("to").alias("end"), "n"))
    total = ends.groupBy("end").agg(F.max("n").alias("total")).join(x.where("sibling IS NULL AND up IS NULL").select((-1 - F.col("id")).alias("end"), F.col("parent").alias("root")), "end")
    return ends.join(total, "end").select("id", "root", (F.col("total") - F.col("n")).alias("pos")).join(x.select("object", "op", "id"), "id").select("object", "root", "op", "pos")


def tree_order(log: DataFrame, object: str = "object", op: str = "op", parent: str = "parent", local: int = 100_000) -> DataFrame:
    """(object, op, pos): pre-order place of each op of a causal tree; repeated ops count once (under the greatest parent), orphans wait outside.

    One row an object holds its ops and parents for the walk, so many small
    objects share an Arrow batch. Objects of more than local ops are ranked by
    joins instead, with the same result.
    """
    x = log.select(F.col(object).cast("long").alias("object"), F.col(op).cast("long").alias("op"), F.col(parent).cast("long").alias("parent"))
    x = x.where("object IS NOT NULL AND op IS NOT NULL AND parent IS NOT NULL").groupBy("object", "op").agg(F.max("parent").alias("parent"))
    big = x.groupBy("object").count().where(F.col("count") > local).select("object").persist()
    if big.isEmpty():
        return _walked(x)
    return _walked(x.join(big, "object", "left_anti")).unionByName(_ranked(x.join(big, "object", "left_semi")).where("root = 0").drop("root"))


def _walked(nodes: DataFrame) -> DataFrame:
    trees = nodes.groupBy("object").agg(F.collect_list(F.struct("op", "parent")).alias("e")).select("object", F.col("e.op").alias("ops"), F.col("e.parent").alias("parents"))
    return trees.mapInArrow(_orders, "object long, ops array<long>").select("object", F.posexplode("ops").alias("pos", "op")).select("object", "op", F.col("pos").cast("long").alias("pos"))


def tree_deleted(log: DataFrame, object: str, op: str, parent: str, empty) -> DataFrame:
    """log with deleted: an empty payload itself, or a child with one."""
    marks = log.where(empty).select(object, F.col(parent).alias(op)).distinct().withColumn("_d", F.lit(True))
    return log.join(marks, [object, op], "left").withColumn("deleted", F.coalesce(F.col("_d"), F.lit(False)) | empty).drop("_d")


def list_order(log: DataFrame) -> DataFrame:
    """(object, op, pos) of a replicated list of inserts: rows object, op, ref (0: at the start), each after its ref.

    Concurrent inserts at one place stand by descending id, each with what
    was inserted after it: the pre-order of the insertion tree.
    """
    return tree_order(log, parent="ref")


def depths(tree: DataFrame, object: str, op: str, parent: str, most: int = 64) -> DataFrame:
    """(object, op, depth) of a grow-only tree by pointer doubling: log(depth) joins, no recursion.

    most bounds the rounds at 2**most levels, beyond any table.
    """
    x = tree.select(object, op, F.col(parent).alias("_up"), F.lit(1).cast("long").alias("depth")).dropDuplicates([object, op])
    for _ in range(most):
        x = kept(x)
        if x.where("_up <> 0").isEmpty():
            return x.select(object, op, "depth")
        up = x.select(object, F.col(op).alias("_up"), F.col("_up").alias("_next"), F.col("depth").alias("_more"))
        joined = x.join(up, [object, "_up"], "left")
        x = joined.select(object, op, F.coalesce("_next", F.lit(0).cast("long")).alias("_up"), (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"))
    raise ValueError("the tree has a cycle")


def chained(items: DataFrame, key: list[str], order: str, op: str = "op", ref: str = "ref") -> DataFrame:
    """A new list or causal tree of items in order: each op refers to the one before it, the first to 0."""
    by = ", ".join(key)
    x = items.withColumn(op, F.expr(f"CAST(row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS BIGINT)"))
    return x.withColumn(ref, F.col(op) - 1)


def text_of(rows: DataFrame, key: list[str], pos: str, payload: str, separator: str = "") -> DataFrame:
    """Each object's payloads joined in order."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(pos, payload))), lambda s: s[payload]), separator)
    return rows.groupBy(*key).agg(joined.alias("text"))
