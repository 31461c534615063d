"""Objects that refer to objects, read into nested columns and written from them.

A log has a row an alive op: object, field, op, value (text) and ref, the id
of another object where the payload is one. Reading goes down level by level:
each round joins the references of the objects met before. Then all objects
are read at once, and back up what was read becomes a struct or an array of
structs of its parent. Writing lays a nested row out in nesting order; its
place there, after those of the rows before, gives every object and op its event.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import scans, views
from tidelog.shared import kept, shared_dir

#: Rows that are laid out at a time.
ROWS = 1024


@dataclass(frozen=True)
class Object:
    """A type: fields with a merge strategy for values, or the type of the object that the last reference names."""

    fields: dict

    def __post_init__(self):
        if taken := {"object", "status"} & {f.lower() for f in self.fields}:
            raise ValueError(f"what is read has columns of its own named {' and '.join(sorted(taken))}")


@dataclass(frozen=True)
class Objects(Object):
    """The objects that a field's alive references name, in order of the references' ops."""


def read(log: DataFrame, roots: DataFrame, type: Object) -> DataFrame:
    """(object, status, and a column a field) of each row of roots (object).

    Where an object has no rows its status is missing, where it stands in
    itself it is cycle; both have null fields, and what was read is ok. A
    field without a reference is null, of Objects an empty array. Repeated
    roots are read once.

    Going down takes the references alone; an object is reduced once, where
    its ops are before they are dealt out, and then all levels meet the objects.
    """
    shared_dir(log.sparkSession)  # tables between the levels need one
    links = _links(type)
    refs = kept(log.where(F.col("field").isin(*links) & F.col("ref").isNotNull()).select("object", "field", "op", "ref")) if links else None
    named = F.monotonically_increasing_id().alias("_at")  # fixed by the table that it is written to
    none, no = F.lit(None), F.lit(False)
    top = roots.select("object").where("object IS NOT NULL").distinct().select(named, none.cast("long").alias("_up"), none.cast(log.schema["op"].dataType).alias("_op"), "object", no.alias("_again"), F.array("object").alias("_path"))
    levels: list[tuple[Object, DataFrame, dict[str, int]]] = []

    def down(met: DataFrame, type: Object) -> int:
        """Number of the level of objects met as that type; those below it are added too."""
        number, below = len(levels), {}
        levels.append((type, met, below))
        for f, kind in type.fields.items():
            if isinstance(kind, str):
                continue
            own = refs.where(F.col("field") == f)
            each = own.repartition("object").groupBy("object", "ref").agg(F.min("op").alias("_op")) if isinstance(kind, Objects) else own.groupBy("object").agg(F.max_by("ref", "op").alias("ref"))
            deep = bool(_links(kind))  # what refers to nothing needs no number, and no table that fixes it
            order = F.col("_op") if isinstance(kind, Objects) else none.cast(log.schema["op"].dataType).alias("_op")
            x = met.where(~F.col("_again")).select("object", F.col("_at").alias("_up"), "_path").join(each, "object").select(named if deep else none.cast("long").alias("_at"), "_up", order, F.col("ref").alias("object"), F.array_contains("_path", F.col("ref")).alias("_again"), F.array_append("_path", F.col("ref")).alias("_path"))
            below[f] = down(kept(x) if deep else x.drop("_path"), kind)
        return number

    down(kept(top), type)
    met = reduce(DataFrame.unionByName, [x.select(F.lit(n).alias("_level"), "_at", "_up", "_op", "object", "_again") for n, (_, x, _) in enumerate(levels)])
    plain = {p: f"_v{i}" for i, p in enumerate(dict.fromkeys((f, how) for t, _, _ in levels for f, how in t.fields.items() if isinstance(how, str)))}
    there = log.groupBy("object").agg(F.lit("ok").alias("status"), *[views.strategy(how, "value", "op", F.col("field") == f).alias(v) for (f, how), v in plain.items()])
    again, value = F.col("_again"), lambda v: F.when(~F.col("_again"), F.col(v)).alias(v)
    got = met.join(there, "object", "left").select("_level", "_at", "_up", "_op", "object", F.when(again, F.lit("cycle")).otherwise(F.coalesce("status", F.lit("missing"))).alias("status"), *map(value, plain.values()))
    got = kept(got)

    def up(number: int) -> DataFrame:
        type, _, below = levels[number]
        own = [F.col(plain[f, how]).alias(f) for f, how in type.fields.items() if isinstance(how, str)]
        out = got.where(F.col("_level") == number).select("_at", "_up", "_op", "object", "status", *own)
        for f, n in below.items():
            kind = type.fields[f]
            per = up(n).select(F.col("_up").alias("_at"), "_op", F.struct("object", "status", *kind.fields).alias(f))
            if isinstance(kind, Objects):
                per = per.groupBy("_at").agg(F.transform(F.sort_array(F.collect_list(F.struct("_op", f))), lambda k: k[f]).alias(f))  # noqa: B023
            out = out.join(per.select("_at", f), "_at", "left")
            if isinstance(kind, Objects):
                out = out.withColumn(f, F.when(F.col("status") == "ok", F.coalesce(f, F.array().cast(per.schema[f].dataType))))
        return out.select("_at", "_up", "_op", "object", "status", *type.fields)

    return up(0).drop("_at", "_up", "_op")


def _links(type: Object) -> set[str]:
    """The fields that refer to objects, of a type and of those below it."""
    below = {f: kind for f, kind in type.fields.items() if isinstance(kind, Object)}
    return set(below).union(*map(_links, below.values()))


def closure(roots: DataFrame, refs: DataFrame, upto: int | None = None) -> DataFrame:
    """(root, object, depth): all that the references (object, ref) lead to from each of roots (object), in upto steps where that is given; what is in a circle comes once, with its least depth."""
    shared_dir(refs.sparkSession)  # checkpoints need one
    edges = refs.where("object IS NOT NULL AND ref IS NOT NULL").select("object", "ref").distinct()
    front = roots.where("object IS NOT NULL").select(F.col("object").alias("root"), "object", F.lit(0).alias("depth")).distinct().checkpoint()
    found = front
    for depth in count(1):
        if upto is not None and depth > upto:
            return found
        front = front.join(edges, "object").select("root", F.col("ref").alias("object"), F.lit(depth).alias("depth")).distinct().join(found.select("root", "object"), ["root", "object"], "left_anti").checkpoint()
        if front.isEmpty():
            return found
        found = found.unionByName(front).checkpoint()


def _texts(value: Column, type: Object) -> Column:
    """An object's fields by name and in order, all values as text."""
    out = []
    for f, kind in type.fields.items():
        v = value[f]
        if isinstance(kind, Objects):
            v = F.transform(v, lambda x: F.when(x.isNotNull(), _texts(x, kind)))  # noqa: B023
        elif isinstance(kind, Object):
            v = F.when(v.isNotNull(), _texts(v, kind))
        else:
            v = v.cast("array<string>" if kind == "set" else "string")
        out.append(v.alias(f))
    return F.struct(*out)


def _laid_out(values: pa.Array, type: Object) -> tuple[np.ndarray, list[tuple]]:
    """How many events each object takes with what it refers to, and the entries (place in values, field, object, op, value or None for a reference).

    Events count from an object's creation, 0; fields follow in order, and
    what a reference names follows it.
    """
    every = np.arange(len(values))
    size, out = np.ones(len(values), np.int64), []
    for f, kind in type.fields.items():
        v = pc.struct_field(values, f)
        if isinstance(kind, Objects) or kind == "set":
            n = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            of, v = np.repeat(every, n), v.flatten()
        else:
            n = v.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            of, v = every[n > 0], v.drop_null()
        one, below = _laid_out(v, kind) if isinstance(kind, Object) else (np.zeros(len(v), np.int64), [])
        upto = np.concatenate([[0], np.cumsum(one + 1)])
        ends = np.cumsum(n)
        op = size[of] + upto[:-1] - upto[ends - n][of]
        out.append((of, f, np.zeros(len(of), np.int64), op, None if isinstance(kind, Object) else v))
        out += [(of[i], g, o + op[i] + 1, p + op[i] + 1, w) for i, g, o, p, w in below]
        size = size + upto[ends] - upto[ends - n]
    return size, out


def _ops(type: Object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                first = part.column("_first").to_numpy()
                for of, f, object, op, value in _laid_out(part.column("_value"), type)[1]:
                    op, none = pa.array(first[of] + op), pa.nulls(len(of), pa.int64())
                    own = [pa.nulls(len(of), pa.string()), pc.add(op, 1)] if value is None else [value.cast(pa.string()), none]
                    yield pa.RecordBatch.from_arrays([pa.array(first[of] + object), pa.DictionaryArray.from_arrays(np.zeros(len(of), np.int32), [f]).cast(pa.string()), op, *own], ["object", "field", "op", "value", "ref"])

    return run


def written(rows: DataFrame, key: list[str], type: Object, base: int) -> tuple[DataFrame, DataFrame]:
    """(key, object) of each row's root object, and the ops (object, field, op, value, ref) of all objects, as read() takes them.

    Columns of rows named like type's fields are its values, structs and
    arrays of structs where these are objects. Null fields have no op. Events
    follow base in order of key (unique, not null) and nesting.
    """
    x = rows.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(key)], F.struct(*type.fields).alias("_value"))
    x = scans.summed(x, [f"_key{i}" for i in range(len(key))], lambda b: pa.array(_laid_out(b.column("_value"), type)[0]), "_before")
    x = x.select(*[F.col(f"_key{i}").alias(c) for i, c in enumerate(key)], "_value", (F.col("_before") + base + 1).alias("_first"))
    ops = x.select("_first", _texts(F.col("_value"), type).alias("_value")).mapInArrow(_ops(type), "object long, field string, op long, value string, ref long")
    return x.select(*key, F.col("_first").alias("object")), ops
