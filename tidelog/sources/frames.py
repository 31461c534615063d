"""Log rows as frames of bounded size, in the delta-coded text form or the binary form.

Rows are as in types.OPLOG, with key columns that name a frame. A delta-coded
line needs only the row before it, so lines are a window and a grouping of
Column expressions; no row of Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids
from tidelog.sources.text import KEPT, quoted

KEYS = {"*": "type_id", "#": "object_id", "@": "op_id", ":": "ref_id"}
#: The replicated list: the only type whose rows stand in order.
LIST = "rga"


def cut(log: DataFrame, key: list[str], width: int = 256) -> DataFrame:
    """log with part: a frame's rows in parts of at most width chunks of at most width ops, so no frame is unbounded.

    The header is repeated for each slice of a long chunk. Lists stand in
    order: a later slice of one is a patch after the last op of the slice
    before. Reduced, the parts are what the whole is.
    """
    x = log.withColumn("slice", F.floor(F.greatest("op_index", F.lit(0)) / width)).withColumn("range", F.floor(F.col("chunk_no") / width))
    heads, chunk = x.where("op_index < 0"), [*key, "chunk_no"]
    lasts = x.where("op_index >= 0 AND chunk_kind <> 'closed'").groupBy(*chunk, "slice").agg(F.max_by("op_id", "op_index").alias("_last"))
    here = lasts.where("slice > 0").select(*chunk, "slice")
    before = lasts.select(*chunk, (F.col("slice") + 1).alias("slice"), "_last")
    ordered = ids.encode60_short(F.col("type_id.value")) == LIST
    more = heads.drop("slice").join(here.join(before, [*chunk, "slice"]), chunk)
    more = more.withColumn("ref_id", F.when(ordered, F.col("_last")).otherwise(F.col("ref_id"))).select(*x.columns)
    return x.unionByName(more).withColumn("part", F.struct("range", "slice")).drop("range", "slice")


def _kept(base: Column, this: Column) -> Column:
    """The form that keeps leading letters of a base; null where another field differs or under four letters agree."""
    a, b, u, v = base["letters"], this["letters"], base["id"], this["id"]
    out = F.when(a == b, F.lit(""))
    for sign, n in sorted(KEPT.items(), key=lambda x: -x[1]):
        out = out.when(F.substring(a, 1, n) == F.substring(b, 1, n), F.concat(F.lit(sign), F.regexp_replace(F.substring(b, n + 1, 10), "0+$", "")))
    alike = (u["variant"] == 0) & (v["variant"] == 0) & (u["variety"] == v["variety"]) & (u["version"] == v["version"]) & (u["origin"] == v["origin"])
    return F.when(alike, out)


def _shortest(forms: Column) -> Column:
    """The first of the shortest forms that are not null."""
    return F.array_min(F.transform(forms, lambda f, i: F.when(f.isNotNull(), F.struct(F.length(f).alias("n"), i.alias("i"), f.alias("form")))))["form"]


def spelled(u: Column) -> Column:
    """An id with its context-free text and its value's letters."""
    return F.struct(u.alias("id"), ids.uuid_text(u).alias("text"), ids.encode60(u["value"]).alias("letters"))


def key_text(same: Column, before: Column, this: Column) -> Column:
    """A key's shortest form; same is the same key of the op before, before the key before in this op (all spelled)."""
    ticked = F.when(~types.is_zero(before["id"]), F.concat(F.lit("`"), _kept(before, this)))
    return _shortest(F.array(this["text"], _kept(same, this), ticked))


def atom_text(base: Column, this: Column) -> Column:
    """An id as an atom; base is the id before it in the payload (both spelled)."""
    forms = F.array(this["text"], F.when(~types.is_zero(base["id"]), _kept(base, this)))
    return F.concat(F.lit(">"), _shortest(F.filter(forms, lambda f: f != "")))


def spelled_atoms(payload: Column) -> Column:
    """(said, id) of each atom: its text, or its spelled id."""
    told = lambda a: F.when(a["tag"] == "string", quoted(a["s"])).when(a["tag"] == "integer", a["i"].cast("string")).when(a["f"].cast("string").rlike("N|I"), F.concat(F.lit("^"), a["f"].cast("string"))).otherwise(a["f"].cast("string"))
    return F.transform(payload, lambda a: F.struct(F.when(a["tag"] != "uuid", told(a)).alias("said"), F.when(a["tag"] == "uuid", spelled(a["u"])).alias("id")))


def payload_text(atoms: Column, base: Column) -> Column:
    """Spelled atoms with a space between them, ids coded against the id before, the first against base."""
    add = lambda acc, a: F.struct(F.coalesce(a["id"], acc["base"]).alias("base"), F.concat(acc["said"], F.lit(" "), F.coalesce(a["said"], atom_text(acc["base"], a["id"]))).alias("said"))
    return F.aggregate(atoms, F.struct(base.alias("base"), F.lit("").alias("said")), add, lambda acc: F.ltrim(acc["said"]))


def delta_coded(log: DataFrame, key: list[str], width: int = 256) -> DataFrame:
    """(key, text) of log rows: each part of a frame as one delta-coded frame that ends with a full stop."""
    zero, names = spelled(types.uuid()), list(KEYS.values())
    x = cut(log, key, width).select(*key, "part", "chunk_no", "op_index", "chunk_kind", spelled_atoms(F.col("payload")).alias("payload"), *[spelled(F.col(c)).alias(c) for c in names])
    w = Window.partitionBy(*key, "part").orderBy("chunk_no", "op_index")
    x = x.select("*", *[F.coalesce(F.lag(c).over(w), zero).alias(f"_{c}") for c in names])
    forms = [key_text(F.col(f"_{c}"), F.col(b) if b else zero, F.col(c)).alias(f"_{c}") for b, c in zip([None, *names], names)]
    x = x.select(*key, "part", "chunk_no", "op_index", "chunk_kind", *forms, payload_text(F.col("payload"), F.col("object_id")).alias("said"))
    body = (F.col("op_index") >= 0) & (F.col("chunk_kind") != "closed")
    shown = [F.when((F.col(f"_{c}") != "") & (~body if sign in "*#" else F.lit(True)), F.concat(F.lit(sign), F.col(f"_{c}"))) for sign, c in KEYS.items()]
    end = F.when(F.col("chunk_kind") == "closed", ";").when(body, ",").when(F.col("chunk_kind") == "query", "?").otherwise("!")
    line = F.concat(F.when(body, "\t").otherwise(""), F.concat_ws("\t", *shown, F.when(F.col("said") != "", F.col("said")), end))
    lines = x.select(*key, "part", F.struct("chunk_no", "op_index", line.alias("line")).alias("line")).groupBy(*key, "part").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return lines.select(*key, F.concat(F.array_join(F.transform("lines", lambda s: s["line"]), "\n"), F.lit("\n.\n")).alias("text"))


def open_text(ops: DataFrame, key: list[str], order: str = "op_index", width: int | None = None) -> DataFrame:
    """(key, text): each group of ops (op_id, ref_id, payload) as an open frame, in order.

    An op leaves out its id where that is the next after the one before, and
    its reference where that is the one before. width: (key, part, text)
    instead, a frame of its own for each so many values of order, so that a
    key with very many ops is many texts.
    """
    if width is not None:
        key, ops = [*key, "part"], ops.withColumn("part", F.floor(F.col(order) / width))
    before = F.coalesce(F.lag("op_id").over(Window.partitionBy(*key).orderBy(order)), types.uuid())
    x = ops.withColumn("_before", before)
    own = F.when(F.col("op_id") != ids.succ(F.col("_before")), F.concat(F.lit("@"), ids.uuid_text(F.col("op_id")))).otherwise("")
    ref = F.when(F.col("ref_id") != F.col("_before"), F.concat(F.lit(":"), ids.uuid_text(F.col("ref_id")))).otherwise("")
    said = payload_text(spelled_atoms(F.col("payload")), spelled(F.col("op_id")))
    x = x.select(*key, F.struct(order, F.concat_ws("\t", own, ref, F.when(said != "", said)).alias("line")).alias("line"))
    lines = x.groupBy(*key).agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return lines.select(*key, F.concat(F.array_join(F.transform("lines", lambda s: s["line"]), ",\n"), F.lit(";\n")).alias("text"))


def op_text(op_id: Column, ref_id: Column, payload: Column) -> Column:
    """An op with both keys."""
    return F.concat_ws("\t", F.concat(F.lit("@"), ids.uuid_text(op_id)), F.concat(F.lit(":"), ids.uuid_text(ref_id)), payload_text(spelled_atoms(payload), spelled(op_id)))


def state_frame(log: DataFrame, key: list[str]) -> DataFrame:
    """log as objects' states: of several chunks of an object in a frame the last stays; raw ops and queries fail the job."""
    kind = F.when(F.col("chunk_kind") == "value", F.col("chunk_kind")).otherwise(F.raise_error(F.concat(F.lit("a state frame has only states, not "), F.col("chunk_kind"))))
    x = log.withColumn("chunk_kind", kind)
    last = x.groupBy(*key, "object_id").agg(F.max("chunk_no").alias("chunk_no"))
    return x.join(last, [*key, "object_id", "chunk_no"], "left_semi")


def states_text(states: DataFrame, key: list[str]) -> DataFrame:
    """(key, text): the states of each frame as one text, objects in the order of their ids."""
    at = states.select(*key, "object_id").distinct().withColumn("_at", F.row_number().over(Window.partitionBy(*key).orderBy("object_id")) - 1)
    x = states.join(at, [*key, "object_id"]).withColumn("chunk_no", F.col("_at")).drop("_at")
    return delta_coded(x, key)
