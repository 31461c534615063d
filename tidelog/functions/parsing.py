"""Pieces of the text form in columns: ids, atoms, payloads, strings and single ops.

Texts go to Python in Arrow batches. A text that is not wholly one such piece
gives null.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog import types
from tidelog.sources import text

OP = f"struct<type_id: {types.UUID}, object_id: {types.UUID}, op_id: {types.UUID}, ref_id: {types.UUID}, payload: {types.PAYLOAD}>"
_OPEN_OP = f"struct<op_id: {types.UUID}, ref_id: {types.UUID}, payload: {types.PAYLOAD}>"
_ID = pa.struct([("variety", pa.int8()), ("value", pa.int64()), ("variant", pa.int8()), ("version", pa.int8()), ("origin", pa.int64())])
_ATOMS = pa.list_(pa.field("element", pa.struct([("tag", pa.string()), ("i", pa.int64()), ("f", pa.float64()), ("s", pa.string()), ("u", _ID)])))
_OPEN_OP_KIND = pa.struct([("op_id", _ID), ("ref_id", _ID), ("payload", _ATOMS)])
_OP_KIND = pa.struct([("type_id", _ID), ("object_id", _ID), *_OPEN_OP_KIND])


def _whole(read: Callable, t: str | None, *context):
    """What read makes of a text and where it ends; None if it does not end with the text."""
    if t is None:
        return None
    try:
        t = t.strip()
        got, at = read(t, *context)
        return got if at == len(t) else None
    except (ValueError, KeyError, IndexError):
        return None


def _rows(ids: pa.StructArray) -> list[tuple]:
    """Ids as tuples; a null is the zero id."""
    return [text.ZERO if r[0] is None else r for r in zip(*(c.to_pylist() for c in ids.flatten()))]


def _uuid(texts: pa.Array) -> pa.Array:
    return text._id_column([_whole(text.read_id, t, 0, text.ZERO, text.ZERO) for t in texts.to_pylist()], _ID)


def _uuid_key(same: pa.Array, before: pa.Array, texts: pa.Array) -> pa.Array:
    return text._id_column([_whole(text.read_id, t, 0, s, b) for s, b, t in zip(_rows(same), _rows(before), texts.to_pylist())], _ID)


def parse_uuid(t: Column) -> Column:
    """An id from its context-free text."""
    return F.arrow_udf(_uuid, types.UUID)(t)


def parse_uuid_key(same: Column, before: Column, t: Column) -> Column:
    """An id in key position: same is the same key's id in the op before, before the id before in this op."""
    return F.arrow_udf(_uuid_key, types.UUID)(same, before, t)


def parse_uuid_atom(before: Column, t: Column) -> Column:
    """An id in value position, after the id before."""
    return parse_uuid_key(before, before, t)


def _payload(texts: pa.Array) -> pa.Array:
    return text._payload_column([_whole(text._atoms, t, 0, text.ZERO) for t in texts.to_pylist()], _ATOMS)


def parse_payload(t: Column) -> Column:
    """The atoms of a text."""
    return F.arrow_udf(_payload, types.PAYLOAD)(t)


def parse_atom(t: Column) -> Column:
    """The one atom of a text."""
    p = parse_payload(t)
    return F.when(F.size(p) == 1, p[0])


def parse_string(t: Column) -> Column:
    """The value of a quoted string."""
    a = parse_atom(t)
    return F.when(a["tag"] == "string", a["s"])


def _structs(got: list[tuple | None], kind: pa.StructType) -> pa.Array:
    """Ids and, last, a payload of each op (None: null) as a column."""
    none = (text.ZERO,) * (len(kind) - 1) + ([],)
    *own, payload = list(zip(*[none if g is None else g for g in got])) or [()] * len(kind)
    columns = [*[text._id_column(c, f.type) for c, f in zip(own, kind)], text._payload_column(payload, _ATOMS)]
    return pa.StructArray.from_arrays(columns, fields=list(kind), mask=pa.array([g is None for g in got], pa.bool_()))


def _read_op(t: str | None) -> tuple | None:
    try:
        frames = list(text.frames((t or "").strip(), row=text.plain_row))
    except (ValueError, KeyError, IndexError):
        return None
    if len(frames) != 1 or len(frames[0]) != 1:
        return None
    _, kind, type, object, _, _, _, op, ref, payload = frames[0][0]
    return (type, object, op, ref, payload) if kind == "closed" else None


def _op(texts: pa.Array) -> pa.Array:
    return _structs([_read_op(t) for t in texts.to_pylist()], _OP_KIND)


def parse_op(t: Column) -> Column:
    """A context-free op with its four keys."""
    return F.arrow_udf(_op, OP)(t)


def _read_open_op(t: str | None) -> tuple | None:
    try:
        ops = text.open_ops((t or "").strip(), row=text.plain_row)
    except ValueError:
        return None
    return ops[0][-3:] if len(ops) == 1 else None


def _open_op(texts: pa.Array) -> pa.Array:
    return _structs([_read_open_op(t) for t in texts.to_pylist()], _OPEN_OP_KIND)


def parse_open_op(t: Column) -> Column:
    """An open op: without an id it is the first after the zero id, without a reference it refers to that."""
    return F.arrow_udf(_open_op, _OPEN_OP)(t)
