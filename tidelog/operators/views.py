"""Typed reads of object state: one merge strategy a field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids


def strategy(name: str, value: str, op: str, where: Column | None = None) -> Column:
    """The aggregate of a field's alive values: lww, max, min or set; merged() is the strategy of references to objects."""
    v = F.col(value) if where is None else F.when(where, F.col(value))
    o = F.col(op) if where is None else F.when(where, F.col(op))
    both = F.struct(F.col(op).alias("o"), F.col(value).alias("v"))
    made = {
        "lww": lambda: F.max(both if where is None else F.when(where, both))["v"],  # other fields' rows are null, which takes no room while objects are dealt out
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
        "set": lambda: F.transform(F.sort_array(F.collect_list(F.when(o.isNotNull(), F.struct(o.alias("o"), v.alias("v"))))), lambda s: s["v"]),
    }
    if name not in made:
        raise ValueError(f"no merge strategy {name}")
    return made[name]()


def struct_view(state: DataFrame, key: str, field: str, value: str, op: str, fields: dict[str, str]) -> DataFrame:
    """One row an object, one column a field, each by its strategy."""
    return state.groupBy(key).agg(*[strategy(s, value, op, F.col(field) == f).alias(f) for f, s in fields.items()])


def under_path(log: DataFrame, payload: str, path: list) -> DataFrame:
    """Ops whose payload starts with path, with the path taken off."""
    n = len(path)
    want = F.array(*[F.lit(p) for p in path])
    return log.where(F.slice(payload, 1, n) == want).withColumn(payload, F.slice(F.col(payload), n + 1, F.greatest(F.size(payload) - n, F.lit(0))))


def merged(refs: DataFrame, states: DataFrame, key: list[str], ref: str, object: str, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(key, and what reduce makes) of the objects that each key's alive references name, merged into the one with the least id.

    states has a row an op with its object; reduce gets the rows of all
    merged objects with key and the least id in place of the object, and
    keeps both. References to objects without rows add nothing.
    """
    least = refs.groupBy(*key).agg(F.min(ref).alias("_least"))
    named = refs.select(*key, F.col(ref).alias(object)).distinct().join(least, key)
    return reduce(named.join(states, object).withColumn(object, F.col("_least")).drop("_least"))


def required(value: Column, what: str) -> Column:
    """value; the job fails where it is null."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"no {what}")))


def only(payload: Column, tag: str) -> Column:
    """The atom of a payload that is just one of that tag, else null."""
    first = F.get(payload, F.lit(0))
    return F.when((F.size(payload) == 1) & (first["tag"] == tag), first)


def optional(payload: Column) -> Column:
    """A payload without the name "some" that older writers put before values; null where it is empty."""
    first = F.get(payload, F.lit(0))
    some = (first["tag"] == "uuid") & (ids.name_of(first["u"])["scope"] == "some")
    bare = F.when(F.coalesce(some, F.lit(False)), F.slice(payload, 2, F.greatest(F.size(payload) - 1, F.lit(0)))).otherwise(payload)
    return F.when(F.size(bare) > 0, bare)


def boolean(payload: Column) -> Column:
    """The truth value of a payload, the name true or false; null for others."""
    name = ids.name_of(only(payload, "uuid")["u"])["scope"]
    return F.when(name == "true", True).when(name == "false", False)
