"""Order-free reducers: every one is a keyed aggregate with partial and final steps.

Merging is idempotent, commutative and associative, so a log may be reduced in
any parts and order. Ties on op id go to the greater payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lww(log: DataFrame, key: list[str], op: str, payload: list[str]) -> DataFrame:
    """Last writer wins: for each key the row of the greatest op id."""
    best = F.max(F.struct(op, *payload)).alias("best")
    return log.groupBy(*key).agg(best).select(*key, f"best.{op}", *[f"best.{c}" for c in payload])


def item_key(op: Column, ref: Column) -> Column:
    """The item that an observed-remove op is about: its reference, or itself where that is 0."""
    return F.when(ref == 0, op).otherwise(ref)


def orset(log: DataFrame, key: list[str], op: str, ref: str, payload: list[str]) -> DataFrame:
    """Observed-remove set state: one row an item; a tombstone (ref not 0) beats the add, the greater tombstone an earlier one.

    payload is the add's own where there is an add.
    """
    item = item_key(F.col(op), F.col(ref)).alias("item")
    x = log.select(*key, item, F.struct(F.col(ref).alias("ref"), F.col(op).alias("op")).alias("mark"), F.struct(*payload).alias("p"), (F.col(ref) == 0).alias("is_add"))
    state = x.groupBy(*key, "item").agg(F.max("mark").alias("mark"), F.coalesce(F.max(F.when(F.col("is_add"), F.col("p"))), F.max("p")).alias("p"))
    return state.select(*key, "item", F.col("mark.op").alias(op), F.col("mark.ref").alias(ref), *[f"p.{c}" for c in payload])


def alive(state: DataFrame, ref: str) -> DataFrame:
    return state.where(F.col(ref) == 0)


def version_vector(log: DataFrame, key: list[str], replica: str, time: str) -> DataFrame:
    """The greatest time of each replica."""
    return log.groupBy(*key, replica).agg(F.max(time).alias(time))


def newer(log: DataFrame, vector: DataFrame, key: list[str], replica: str, time: str) -> DataFrame:
    """Ops that a vector does not cover; an unknown replica covers nothing."""
    seen = vector.select(*key, replica, F.col(time).alias("_seen"))
    return log.join(seen, [*key, replica], "left").where(F.col("_seen").isNull() | (F.col(time) > F.col("_seen"))).drop("_seen")


def covered(log: DataFrame, vector: DataFrame, key: list[str], replica: str, time: str) -> DataFrame:
    """Ops that a vector covers."""
    seen = vector.select(*key, replica, F.col(time).alias("_seen"))
    return log.join(seen, [*key, replica]).where(F.col(time) <= F.col("_seen")).drop("_seen")


def precedes(pairs: DataFrame, vectors: DataFrame, left: str, right: str, key: str, replica: str, time: str) -> DataFrame:
    """pairs with leq: whether every replica of left's vector is in right's with at least its time."""
    a = vectors.select(F.col(key).alias(left), F.col(replica).alias("_r"), F.col(time).alias("_a"))
    b = vectors.select(F.col(key).alias(right), F.col(replica).alias("_r"), F.col(time).alias("_b"))
    told = pairs.join(a, left).join(b, [right, "_r"], "left")
    return told.groupBy(left, right).agg(F.min(F.coalesce(F.col("_a") <= F.col("_b"), F.lit(False))).alias("leq"))


def wire_parts(log: DataFrame, key: list[str], part: str, field: str, op: str, payload: list[str]) -> DataFrame:
    """Fields of each object as reduced: into its state if it has one, else into one patch whose ref is the smallest op id.

    part says of each row whether it came in a state, a patch or as a raw op.
    """
    kind = log.groupBy(*key).agg(F.max(F.col(part) == "state").alias("_s"), F.min(op).alias("_m"))
    kind = kind.select(*key, F.when(F.col("_s"), "state").otherwise("patch").alias("kind"), F.when(F.col("_s"), F.lit(0)).otherwise(F.col("_m")).alias("patch_ref"))
    return lww(log, [*key, field], op, payload).join(kind, key)


def merge(states: list[DataFrame], reduce) -> DataFrame:
    """States of several replicas as one: their union, reduced again."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return reduce(out)


def reduce_frame(log: DataFrame, type: str, registry: dict) -> DataFrame:
    """Every registered type reduced by its own plan (columns alike), the other types passed through."""
    out = log.where(~F.coalesce(F.col(type).isin(*registry), F.lit(False)))
    for name, reduce in registry.items():
        out = out.unionByName(reduce(log.where(F.col(type) == name)))
    return out
