"""Typed objects: fields with a type and a merge strategy, checked once, read as one typed row an object.

Declarations are Python values or rows of a table; there is no schema language.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import views

#: Spark type of each atom type.
ATOMS = {"Bool": "boolean", "Day": "date", "Float": "double", "Integer": "bigint", "String": "string", "UUID": "string"}
#: Types whose values are objects of their own, referred to by id.
OBJECTS = ("CT", "CTString", "ORSet", "ORSet.Map", "ObjectRef", "RGA", "RgaString", "VersionVector")
ORDERED = ("Integer", "Float")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    strategy: str = "lww"


@dataclass(frozen=True)
class Struct:
    """kind lww: a field has one value, the last; kind set: several may be alive, and strategies say how they read."""

    name: str
    kind: str
    fields: tuple[Field, ...]
    #: Columns are named prefix + field, in title case after it if title.
    prefix: str = ""
    title: bool = False
    #: Names of other structs and aliases, and the items of enums.
    aliases: dict[str, str] = field(default_factory=dict)
    enums: dict[str, tuple[str, ...]] = field(default_factory=dict)
    structs: tuple[str, ...] = ()

    def __post_init__(self):
        names = [f.name for f in self.fields]
        if self.kind not in ("lww", "set"):
            raise ValueError(f"{self.name}: no kind {self.kind}")
        if len(set(names)) < len(names):
            raise ValueError(f"{self.name}: a field is declared twice")
        for f in self.fields:
            why = self._fault(f)
            if why:
                raise ValueError(f"{self.name}.{f.name}: {why}")

    def resolved(self, type: str) -> str:
        seen = set()
        while type in self.aliases and type not in seen:
            seen.add(type)
            type = self.aliases[type]
        return type

    def _fault(self, f: Field) -> str | None:
        """Why a field cannot be, or None."""
        kind = self.resolved(f.type)
        is_object = kind in OBJECTS or kind in self.structs
        if not is_object and kind not in ATOMS and kind not in self.enums:
            return f"unknown type {f.type}"
        if f.strategy not in ("lww", "max", "min", "set", "merge"):
            return f"unknown strategy {f.strategy}"
        if self.kind == "lww":
            return None if f.strategy == "lww" else "fields of an lww struct have the strategy lww"
        if is_object:
            return None if f.strategy in ("merge", "set") else f"{f.strategy} is not safe for objects: merge and set are"
        if f.strategy == "merge":
            return "atoms do not merge"
        if f.strategy in ("max", "min") and kind not in ORDERED:
            return f"{f.strategy} needs an integer or float field"
        return None

    def column(self, f: Field) -> str:
        return self.prefix + (f.name[:1].upper() + f.name[1:] if self.title else f.name)

    def decoded(self, f: Field, value: Column) -> Column:
        """A value's text as the field's type; null where it does not fit."""
        kind = self.resolved(f.type)
        if kind in self.enums:
            return F.when(value.isin(*self.enums[kind]), value)
        return value.try_cast(ATOMS.get(kind, "string"))


def declared(rows: list[dict], aliases: dict[str, str] | None = None, enums: dict[str, tuple[str, ...]] | None = None) -> dict[str, Struct]:
    """Structs by name from a table of their fields: rows of struct, kind, field, type, strategy, and prefix and title where they are given.

    Fields keep their order. Types may be aliases of aliases, enums, and
    structs of the table. ValueError on a circle of aliases, a name that is
    declared twice, a struct of two kinds, and all that a Struct refuses.
    """
    aliases, enums, made = aliases or {}, enums or {}, {}
    for r in rows:
        made.setdefault(r["struct"], []).append(r)
    known = [*ATOMS, *OBJECTS, *aliases, *enums, *made]
    if twice := {n for n in known if known.count(n) > 1}:
        raise ValueError(f"declared twice: {', '.join(sorted(twice))}")
    for name in aliases:
        path = [name]
        while path[-1] in aliases:
            path.append(aliases[path[-1]])
            if path.count(path[-1]) > 1:
                raise ValueError(f"a circle of aliases: {' = '.join(path)}")
    out = {}
    for name, own in made.items():
        if len(kinds := {(r["kind"], r.get("prefix") or "", bool(r.get("title"))) for r in own}) > 1:
            raise ValueError(f"{name}: declared in two ways")
        kind, prefix, title = kinds.pop()
        out[name] = Struct(name, kind, tuple(Field(r["field"], r["type"], r.get("strategy") or "lww") for r in own), prefix, title, aliases, enums, tuple(made))
    return out


def read(state: DataFrame, roots: DataFrame, name: str, structs: dict[str, Struct]) -> DataFrame:
    """(object, and a column a field) of the objects in roots (object), each of the struct of that name.

    state has the alive values (object, field, op, value as text) of all
    objects. A field that merges is a struct: the least id that it names, as
    object, and the fields of all objects that it names merged into that one;
    null where none of them has a row. Such fields of theirs are ids.
    """
    struct = structs[name]
    own = state.join(roots.select("object").distinct(), "object", "left_semi")
    out = view(own, struct)
    for f in struct.fields:
        inner = structs.get(struct.resolved(f.type))
        if f.strategy != "merge" or inner is None:
            continue
        refs = own.where(F.col("field") == f.name).select(F.col("object").alias("_of"), F.col("value").try_cast(state.schema["object"].dataType).alias("_ref")).where("_ref IS NOT NULL")
        merged = views.merged(refs, state, ["_of"], "_ref", "object", lambda rows, inner=inner: view(rows, inner, key=["_of", "object"]))
        it = F.struct("object", *[inner.column(g) for g in inner.fields]).alias("_it")
        out = out.join(merged.select(F.col("_of"), it), F.col("object") == F.col("_of"), "left").drop("_of").withColumn(struct.column(f), F.col("_it")).drop("_it")
    return out


def view(state: DataFrame, struct: Struct, key: str | list[str] = "object", field: str = "field", op: str = "op", value: str = "value") -> DataFrame:
    """One row an object, one typed column a field: null (set: an empty array) where there is no value or it does not fit.

    state has the alive values as text. A merged reference reads as the
    smallest id of what is alive: the object that the others merge into.
    """
    cells, marks, made = [], [], []
    for i, f in enumerate(struct.fields):
        v, here = struct.decoded(f, F.col(value)), F.col(field) == f.name
        # a value that does not fit empties a last writer's field, and drops out of the other strategies
        fits = here if f.strategy == "lww" else here & v.isNotNull()
        cells.append(F.when(fits, v).alias(f"_v{i}"))
        marks.append(F.when(fits, F.col(op)).alias(f"_o{i}"))
        made.append(views.strategy("min" if f.strategy == "merge" else f.strategy, f"_v{i}", f"_o{i}").alias(struct.column(f)))
    by = [key] if isinstance(key, str) else key
    return state.select(*by, *cells, *marks).groupBy(*by).agg(*made)
