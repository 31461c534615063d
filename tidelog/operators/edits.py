"""Op producers: each returns the ops to append for a change to the observed state.

New op ids come after a base that the caller holds for its replica: base plus
a row number within one object, so ids never depend on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_struct(rows: DataFrame, object: str, fields: list[str], op: str) -> DataFrame:
    """(object, field, op, value) ops of a row a new object: one event for all fields, null for an absent one."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return rows.select(F.col(object).alias("object"), F.col(op).alias("op"), pairs).select("object", "p.field", "op", "p.value")


def removed(state: DataFrame, match: Column, base: Column, key: list[str], item: str = "item", ref: str = "ref") -> DataFrame:
    """Tombstones (key, op, ref) of the alive items that match: one shared event an object, base; only observed items go."""
    return state.where((F.col(ref) == 0) & match).select(*key, base.alias("op"), F.col(item).alias("ref"))


def assigned(state: DataFrame, values: DataFrame, base: Column, key: list[str], item: str = "item", ref: str = "ref", value: str = "value") -> DataFrame:
    """(key, op, ref, value): each new value of values (key, value) as an add at base, and tombstones at base + 1 of what was observed under its key."""
    adds = values.select(*key, base.alias("op"), F.lit(0).cast("long").alias("ref"), F.col(value))
    old = state.where(F.col(ref) == 0).join(values.select(*key).distinct(), key, "left_semi")
    return adds.unionByName(old.select(*key, (base + 1).alias("op"), F.col(item).alias("ref"), F.col(value)))


def inserted(items: DataFrame, key: list[str], after: str, order: str, base: Column) -> DataFrame:
    """items with op and ref: a run inserted after the vertex in after (0: the start), each op after the one before it."""
    by = ", ".join(key)
    x = items.withColumn("n", F.expr(f"row_number() OVER (PARTITION BY {by} ORDER BY {order})"))
    return x.withColumn("op", base + F.col("n")).withColumn("ref", F.when(F.col("n") == 1, F.col(after)).otherwise(base + F.col("n") - 1)).drop("n")


def placed_after(ops: DataFrame, known: DataFrame, key: list[str], ref: str = "ref", op: str = "op") -> DataFrame:
    """ops, with the job failing where one stands after or removes an op that known (key, op) lacks and that is not among ops."""
    there = known.select(*key, op).unionByName(ops.select(*key, op)).distinct().select(*key, F.col(op).alias(ref), F.lit(True).alias("_there"))
    x = ops.join(there, [*key, ref], "left")
    found = F.coalesce("_there", F.col(ref) == 0)
    return x.withColumn(ref, F.when(found, F.col(ref)).otherwise(F.raise_error(F.concat(F.lit("no op "), F.col(ref).cast("string"))))).drop("_there").select(*ops.columns)


def tree_removed(nodes: DataFrame, match: Column, base: Column, key: list[str], op: str = "op") -> DataFrame:
    """(key, op, parent, value): an empty child of each node that matches, which deletes it; events from base + 1 on in order of the nodes."""
    n = F.expr(f"row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY {op})")
    return nodes.where(match).select(*key, (base + n).cast("long").alias("op"), F.col(op).alias("parent"), F.lit(None).cast("string").alias("value"))


def tree_edited(ops: DataFrame, key: list[str], base: Column) -> DataFrame:
    """List edits (key, op, ref, value) as a causal tree's: removals become empty children with events of their own after the inserts'."""
    inserts = ops.where("value IS NOT NULL")
    last = inserts.groupBy(*key).agg(F.max("op").alias("_last"))
    gone = ops.where("value IS NULL").join(last, key, "left").withColumn("_n", F.expr(f"row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY ref)"))
    gone = gone.select(*key, (F.coalesce("_last", base) + F.col("_n")).cast("long").alias("op"), F.col("ref").alias("parent"), F.lit(None).cast("string").alias("value"))
    return inserts.select(*key, F.col("op").cast("long").alias("op"), F.col("ref").alias("parent"), "value").unionByName(gone)


def added(items: DataFrame, key: list[str], order: list[str], payload: list[str], base: Column) -> DataFrame:
    """(key, op, payload): each item of a set or map as an op of its own after base, its id the item's; payload: its columns as text, in order."""
    n = F.expr(f"row_number() OVER (PARTITION BY {', '.join(key)} ORDER BY {', '.join(order)})")
    return items.select(*key, (base + n).cast("long").alias("op"), F.array(*[F.col(c).cast("string") for c in payload]).alias("payload"))


def vector(times: DataFrame, key: list[str], replica: str, time: str) -> DataFrame:
    """(key, op, ref, replica): a version vector as ops, one a replica with its time as the id."""
    return times.select(*key, F.col(time).alias("op"), F.lit(0).cast("long").alias("ref"), F.col(replica))


def children(log: DataFrame, object: str, op: str, parent: str) -> DataFrame:
    """(object, parent, ops): the children of each node of a grow-only tree in order; the object's own creation is no child."""
    return log.where(F.col(op) != F.col(object)).groupBy(object, parent).agg(F.array_sort(F.collect_set(op)).alias("ops"))
