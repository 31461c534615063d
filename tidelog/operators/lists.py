"""Replicated lists: states, patches and removals reduced to a fix-point.

Payloads and tombstones are keyed aggregates and joins. The order of a small
object's ids is found in a task, that of a large one by joins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.functions import ids
from tidelog.operators import scans, sequences
from tidelog.operators.differences import edited  # noqa: F401
from tidelog.shared import few, kept
from tidelog.sources.frames import LIST
from tidelog.sources.text import _word as word

#: The zero id in sortable letters.
ZERO = "0" * 22


def from_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists (object, chunk, ref, pos, op, gone, payload) and removals (object, target, tombstone) of the list type's rows.

    Ids are sortable letters. A raw op without payload removes what it refers
    to, and so does one in a chunk whose reference is a derived id; queries are left out.
    """
    named = {c: ids.sortable(F.col(c)).alias(c) for c in ("object_id", "op_id", "ref_id", "header_ref_id")}
    raw = (F.col("chunk_kind") == "closed") | (F.col("header_ref_id.version") == 3)
    x = log.where((F.col("type_id.value") == word(LIST)) & F.col("chunk_kind").isin("closed", "value") & (F.col("op_index") >= 0))
    x = x.select("frame_no", "chunk_no", "op_index", "payload", raw.alias("raw"), *named.values())
    empty = F.size("payload") == 0
    removals = x.where(F.col("raw") & empty).selectExpr("object_id AS object", "ref_id AS target", "op_id AS tombstone")
    chunk = F.struct("frame_no", "chunk_no", F.when(F.col("raw"), F.col("op_index")).alias("n")).alias("chunk")
    choose = lambda a, b: F.when(F.col("raw"), a).otherwise(b)
    lists = x.where(~(F.col("raw") & empty)).select(
        F.col("object_id").alias("object"), chunk, choose(F.col("ref_id"), F.col("header_ref_id")).alias("ref"), F.col("op_index").alias("pos"), F.col("op_id").alias("op"), choose(F.lit(ZERO), F.col("ref_id")).alias("gone"), "payload"
    )
    return lists, removals


def _placed_under(found: list[tuple]) -> dict:
    """Parent of each op of lists (ref, ops): the op before it in its list that is smaller and nearest, else ref, and above a greater ref what that stands under."""
    parent: dict = {}
    for ref, ops in found:
        stack: list = []
        for o in ops:
            while stack and stack[-1] >= o:
                stack.pop()
            p = stack[-1] if stack else ref
            parent[o] = max(parent.get(o, p), p)
            stack.append(o)
    out = {}
    for o, p in parent.items():
        while p in parent and p > o:
            p = parent[p]
        out[o] = p
    return {o: p for o, p in out.items() if o != p}


def forest(found: list[tuple]) -> dict:
    """The ops of lists (ref, ops) in order, by the id at the top that is none of them: an insertion tree each, siblings by descending id."""
    parent = _placed_under(found)
    below: dict = defaultdict(list)
    for o, p in parent.items():
        below[p].append(o)
    out = {}
    for root in below:
        if root in parent:
            continue
        ops, stack = [], sorted(below[root])
        while stack:
            o = stack.pop()
            ops.append(o)
            stack += sorted(below.get(o, ()))
        out[root] = ops
    return out


def fixed_point(found: list[tuple], zero) -> dict:
    """forest, by the name of what it computes; zero is the state's reference."""
    return forest(found)


def _run(arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few(batches):
            rows = []
            for r in b.to_pylist():
                for ref, ops in forest([(x["ref"], x["ops"]) for x in r["lists"]]).items():
                    rows.append({"object": r["object"], "ref": ref, "ops": ops})
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return run


def _walked(lists: DataFrame) -> DataFrame:
    """(object, ref, pos, op) of objects whose ids fit a task: one row an object, many to a batch."""
    each = lists.groupBy("object", "ref", "chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "op")))["op"].alias("ops"))
    per = each.groupBy("object").agg(F.collect_list(F.struct("ref", "ops")).alias("lists"))
    out = per.select("object", F.col("lists")[0]["ref"].alias("ref"), F.col("lists")[0]["ops"].alias("ops")).schema
    return per.mapInArrow(_run(to_arrow_schema(out)), out).select("object", "ref", F.posexplode("ops").alias("pos", "op")).withColumn("pos", F.col("pos").cast("long"))


def _joined(lists: DataFrame) -> DataFrame:
    """(object, ref, pos, op) of objects of any size: parents by running minima over ranges of lists, order by ranking of the tours of their trees."""
    x = lists.select("object", "ref", F.concat_ws("\x00", F.col("object").cast("string"), F.col("ref").cast("string"), F.col("chunk").cast("string")).alias("list"), "pos", "op")
    x = scans.smaller_before(x, "list", "pos", "op", "parent")
    nodes = x.groupBy("object", "op").agg(F.max(F.coalesce("parent", "ref")).alias("parent"))
    while True:  # a greater reference is no place of its own: up to what it stands under, in steps that double along others of that kind
        nodes = kept(nodes)
        up = nodes.select("object", F.col("op").alias("parent"), F.col("parent").alias("_above"))
        late = nodes.where("parent > op").join(up, ["object", "parent"]).select("object", "op", "_above")
        late = kept(late)
        if late.isEmpty():
            break
        nodes = nodes.join(late, ["object", "op"], "left").select("object", "op", F.coalesce("_above", "parent").alias("parent"))
    return sequences._ranked(nodes.where("op <> parent")).withColumnRenamed("root", "ref")


def payloads(lists: DataFrame) -> DataFrame:
    """(object, op, payload): of repeated ids the longest payload."""
    size = F.size("payload") if lists.schema["payload"].dataType.typeName() == "array" else F.length("payload")
    return lists.groupBy("object", "op").agg(F.max_by("payload", size).alias("payload"))


def placed(lists: DataFrame, removals: DataFrame, zero=ZERO, local: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """As reduced, without payloads."""
    made = lists.groupBy("object", "op").agg(F.max("gone").alias("gone"))
    gone = removals.groupBy("object", F.col("target").alias("op")).agg(F.max("tombstone").alias("tombstone"))
    made = made.join(gone, ["object", "op"], "left").withColumn("gone", F.greatest("gone", F.coalesce("tombstone", F.lit(zero)))).drop("tombstone")
    top = "" if isinstance(zero, str) else -(1 << 63)  # below every id, so that an op may have the zero id itself
    bare = lists.drop("payload", "gone").withColumn("ref", F.when(F.col("ref") == zero, F.lit(top)).otherwise(F.col("ref")))
    big = bare.groupBy("object").count().where(F.col("count") > local).select("object").persist()
    if big.isEmpty():
        order = _walked(bare)
    else:
        order = _walked(bare.join(big, "object", "left_anti")).unionByName(_joined(bare.join(big, "object", "left_semi")))
    order = order.withColumn("ref", F.when(F.col("ref") == top, F.lit(zero)).otherwise(F.col("ref")))
    waiting = removals.join(lists.select("object", F.col("op").alias("target")), ["object", "target"], "left_anti").groupBy("object", "target").agg(F.max("tombstone").alias("tombstone"))
    return order.join(made, ["object", "op"]).select("object", "ref", "pos", "op", "gone"), waiting


def reduced(lists: DataFrame, removals: DataFrame, zero=ZERO, local: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """(object, ref, pos, op, gone, payload) with all that applies applied, and the removals whose target has not arrived.

    ref is zero for the state's vertices, else the id a waiting patch stands
    after. gone is zero or the greatest tombstone; of repeated ids the longest
    payload stays. An insert after zero counts as a state of its own.

    States, patches and raw inserts are taken as one insertion forest. In a
    list whose ops are greater than what they were inserted after, an op
    stands under the nearest smaller one before it, so a state tells its
    tree. An id that lists place differently stands under the greatest of its
    places. Of ops that refer to each other in a circle the least is left
    out, and the others wait for it.

    Objects of up to local ids are put in order in one task each, larger ones
    by joins, with the same result.
    """
    order, waiting = placed(lists, removals, zero, local)
    return order.join(payloads(lists), ["object", "op"]).select("object", "ref", "pos", "op", "gone", "payload"), waiting
