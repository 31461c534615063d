"""Whole frames reduced to frames, on the log schema.

Rows are grouped by type and object. Registered types are reduced, each by
aggregates of its own; states, patches and raw ops of a group become one
state, or one patch where there is no state. Other types and queries pass
through. Lists keep what cannot be placed yet as patches and raw removals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids
from tidelog.operators import lists
from tidelog.shared import shared_dir
from tidelog.sources.text import _word as word

#: Names of the registered types: fixed values.
LWW, LIST, SET, VECTOR = "lww", "rga", "set", "vv"
KEY = ["type_id", "object_id"]
#: How a reduced op is found: the key of a type's item.
ITEMS = {
    LWW: lambda: F.col("ref_id"),
    SET: lambda: F.when(types.is_zero(F.col("ref_id")), F.col("op_id")).otherwise(F.col("ref_id")),
    VECTOR: lambda: types.uuid(F.col("op_id.variety") % 4, 0, 0, 0, F.col("op_id.origin")),
}
#: What decides between two ops of one item: the greater stays. Tombstones beat adds; times compare by their first half alone.
RANKS = {
    LWW: lambda: F.struct(F.col("op_id")),
    SET: lambda: F.struct(F.col("ref_id"), F.col("op_id")),
    VECTOR: lambda: F.struct(F.col("op_id.variety"), F.col("op_id.value")),
}


def _is(*names: str) -> Column:
    """Whether a row's type is one of these names."""
    named = (F.col("type_id.variety") == 0) & (F.col("type_id.version") == 0) & (F.col("type_id.origin") == 0)
    return named & F.col("type_id.value").isin(*[word(n) for n in names])


def _chunks(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Log rows of one chunk a (type, object, kind, ref) from rows with op_id, ref_id, payload, and its header."""
    chunk = [*KEY, "header_ref_id"]
    body = rows.where("op_id IS NOT NULL").withColumn("op_index", (F.row_number().over(Window.partitionBy(*chunk).orderBy(*order)) - 1).cast("int"))
    head = rows.select(*chunk).distinct().select(*chunk, F.lit(-1).alias("op_index"), types.uuid().alias("op_id"), F.col("header_ref_id").alias("ref_id"), F.array().cast(types.PAYLOAD).alias("payload"))
    both = head.unionByName(body.select(*chunk, "op_index", "op_id", "ref_id", "payload"))
    return both.select(*KEY, F.lit("value").alias("chunk_kind"), types.uuid().alias("header_op_id"), "header_ref_id", "op_index", "op_id", "ref_id", "payload")


def _reduced_items(log: DataFrame, name: str) -> DataFrame:
    """One chunk an object: its state, or a patch from the least reference or raw op on."""
    x = log.where(_is(name) & F.col("chunk_kind").isin("value", "closed"))
    raw = F.col("chunk_kind") == "closed"
    state = ~raw & types.is_zero(F.col("header_ref_id"))
    least = F.min(F.when(raw, F.col("op_id")).when(~state, F.col("header_ref_id")))
    kinds = x.groupBy(*KEY).agg(F.when(F.max(state), types.uuid()).otherwise(least).alias("header_ref_id"))
    ops = x.where("op_index >= 0").groupBy(*KEY, ITEMS[name]().alias("_item")).agg(F.max_by(F.struct("op_id", "ref_id", "payload"), F.struct(RANKS[name](), F.col("payload"))).alias("o"))
    rows = kinds.join(ops, KEY, "left").select(*KEY, "header_ref_id", "o.op_id", "o.ref_id", "o.payload")
    return _chunks(rows, ["ref_id", "op_id"] if name == LWW else ["op_id"])


def _reduced_lists(log: DataFrame) -> DataFrame:
    """Each object's state, the patches that wait, and as raw ops the removals that wait."""
    x = log.where(_is(LIST))
    rows, waiting = lists.reduced(*lists.from_log(x))
    typed = x.select(*KEY, ids.sortable(F.col("object_id")).alias("object")).distinct()
    u = ids.from_sortable
    ops = rows.join(typed, "object").select(*KEY, u(F.col("ref")).alias("header_ref_id"), "pos", u(F.col("op")).alias("op_id"), u(F.col("gone")).alias("ref_id"), "payload")
    empty = x.where((F.col("chunk_kind") == "value") & (F.col("op_index") < 0) & types.is_zero(F.col("header_ref_id"))).select(*KEY, "header_ref_id").distinct()
    empty = empty.select("*", F.lit(None).cast("int").alias("pos"), *[F.lit(None).cast(t).alias(c) for c, t in (("op_id", types.UUID), ("ref_id", types.UUID), ("payload", types.PAYLOAD))])
    raw = waiting.join(typed, "object").select(
        *KEY, F.lit("closed").alias("chunk_kind"), types.uuid().alias("header_op_id"), types.uuid().alias("header_ref_id"), F.lit(0).alias("op_index"),
        u(F.col("tombstone")).alias("op_id"), u(F.col("target")).alias("ref_id"), F.array().cast(types.PAYLOAD).alias("payload"),
    )
    return _chunks(ops.unionByName(empty), ["pos"]).unionByName(raw)


def frame_name() -> Column:
    """A reduced object's frame: the letters of its type and id."""
    return F.concat(ids.sortable(F.col("type_id")), ids.sortable(F.col("object_id")))


def reduce_log(log: DataFrame) -> DataFrame:
    """(frame, and the columns of log rows): every object of every frame of log reduced, as a frame of its own.

    Of rows of one op the greatest payload stays. Unknown types and queries
    come out as they are, queries as the last chunks. Rows with an error are
    left out; an empty log gives no rows. The log is checkpointed, since each
    type reads it by itself.
    """
    shared_dir(log.sparkSession)  # checkpoints need one
    log = log.checkpoint()
    columns = ["chunk_kind", *KEY, "header_op_id", "header_ref_id", "op_index", "op_id", "ref_id", "payload"]
    known = _is(LWW, LIST, SET, VECTOR) & (F.col("chunk_kind") != "query")
    out = _reduced_lists(log).select(*columns)
    for name in ITEMS:
        out = out.unionByName(_reduced_items(log, name).select(*columns))
    out = out.withColumn("_at", F.struct(F.lit(0).cast("long").alias("frame_no"), F.lit(0).alias("chunk_no"))).unionByName(log.where(~known & F.col("chunk_kind").isNotNull()).select(*columns, F.struct("frame_no", "chunk_no").alias("_at")))
    out = out.withColumn("frame", frame_name())
    place = F.struct((F.col("chunk_kind") == "query").alias("q"), (F.col("chunk_kind") == "closed").alias("c"), "header_ref_id", "_at", F.when(F.col("chunk_kind") == "closed", F.col("op_id")).alias("op"))
    numbered = out.withColumn("chunk_no", (F.dense_rank().over(Window.partitionBy("frame").orderBy(place)) - 1).cast("int"))
    return numbered.select("frame", F.lit(0).cast("long").alias("frame_no"), "chunk_no", *columns)


def typed(log: DataFrame, name: str) -> DataFrame:
    """Rows of one type; a row of another type fails the job."""
    return log.withColumn("type_id", F.when(_is(name), F.col("type_id")).otherwise(F.raise_error(F.concat(F.lit(f"expected type {name}, got "), ids.uuid_text(F.col("type_id"))))))


def as_type(rows: DataFrame, name: str) -> DataFrame:
    """rows tagged with a type."""
    return rows.withColumn("type_id", types.uuid(0, ids.decode60(F.lit(name))))
