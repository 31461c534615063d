"""The text form of operation logs.

Ids are delta-coded against the op before, so a frame is read from its start
to its end; frames are independent and spread over the cluster. Writing uses
the context-free form and is a plain aggregate of Column expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tidelog import types
from tidelog.functions import ids

ZERO = (0, 0, 0, 0, 0)
_LETTER = {c: i for i, c in enumerate(ids.BASE64)}
#: How many letters of the base each sign stands for, and the signs of versions: fixed values.
KEPT = {"(": 4, "[": 5, "{": 6, "}": 7, "]": 8, ")": 9}
_VERSIONS = "$%+-"
_ID = re.compile(r"(?P<tick>`?)(?:(?P<variety>[0-9A-F])/)?(?P<keep>[(\[{}\])]?)(?P<value>[0-9A-Za-z_~]*)(?P<version>[$%+-]?)(?P<keep2>[(\[{}\])]?)(?P<origin>[0-9A-Za-z_~]*)")
_SPACE = re.compile(r"\s*")
#: After the sign of floats; not-a-number and the infinities have no form without it.
_FLOAT = re.compile(r"[+-]?(?:\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|Infinity(?![0-9A-Za-z_~])|NaN(?![0-9A-Za-z_~]))")
_INTEGER = re.compile(r"[+-]?\d+")
_DEFINITE = re.compile(r"[+-]?\d+(?:\.\d+(?:[eE][+-]?\d+)?|[eE][+-]?\d+)(?![0-9A-Za-z_~])")
_PLAIN_INTEGER = re.compile(r"[+-]?\d+(?![0-9A-Za-z_~$%/])")
_STRING = re.compile(r"'((?:[^'\\]|\\.)*)'", re.S)


@lru_cache(1 << 15)
def _word(letters: str) -> int:
    v = 0
    for c in letters.ljust(10, "0")[:10]:
        v = v << 6 | _LETTER[c]
    return v


def _past_space(text: str, at: int) -> int:
    """The place of the next character that is no white space, from a place on."""
    return at if text[at : at + 1] > " " and text[at] < "\x7f" else _SPACE.match(text, at).end()


def _joined(keep: str, letters: str, base: int) -> int:
    """A field from the kept leading letters of its base and new letters after them."""
    n = KEPT.get(keep, 0)
    if not n and not letters:
        return base
    low = 60 - 6 * n
    return (base >> low << low) | (_word(letters) >> 6 * n)


def read_id(text: str, at: int, same: tuple, before: tuple) -> tuple[tuple, int]:
    """The id at a place: same is the same key's id in the op before, before the id before in this op."""
    m = _ID.match(text, at)
    if m.end() == at:
        raise ValueError(f"no id at {at}")
    value, version, origin = m["value"], m["version"], m["origin"]
    if not m["tick"] and not m["keep"] and m["variety"] is None:
        if len(value) == 22 and not version and not m["keep2"]:
            low = _LETTER[value[11]]
            return (_LETTER[value[0]] & 15, _word(value[1:11]), low >> 2 & 3, low & 3, _word(value[12:])), m.end()
        if len(value) == 11:
            return (_LETTER[value[0]] & 15, _word(value[1:]), 0, _VERSIONS.index(version) if version else 0, _word(origin)), m.end()
    if len(value) > 10 or len(origin) > 10:
        raise ValueError(f"id too long at {at}")
    base = before if m["tick"] else same
    variety = int(m["variety"], 16) if m["variety"] else None
    alone = not m["tick"] and not m["keep"] and value and not m["keep2"] and (not version or origin)
    if alone or base[2]:
        return (variety or 0, _word(value), 0, _VERSIONS.index(version) if version else 0, _word(origin)), m.end()
    kept = base[0] if variety is None else variety
    return (kept, _joined(m["keep"], value, base[1]), 0, _VERSIONS.index(version) if version else base[3], _joined(m["keep2"], origin, base[4])), m.end()


def _atoms(text: str, at: int, base: tuple) -> tuple[list[tuple], int]:
    """(tag, i, f, s, u) of each atom from a place on; the last id is the next one's base."""
    out = []
    while True:
        at = _past_space(text, at)
        c = text[at : at + 1]
        if c == "^" and (m := _FLOAT.match(text, _past_space(text, at + 1))):
            out.append(("float", None, float(m[0]), None, None))
        elif c == "=" and (m := _INTEGER.match(text, _past_space(text, at + 1))):
            out.append(("integer", int(m[0]), None, None, None))
        elif c == "'" and (m := _STRING.match(text, at)):
            body = re.sub(r'(?<!\\)((?:\\\\)*)"', r'\1\\"', m[1].replace("\\'", "'"))
            out.append(("string", None, None, json.loads(f'"{body}"', strict=False), None))
        elif m := _DEFINITE.match(text, at):
            out.append(("float", None, float(m[0]), None, None))
        elif m := _PLAIN_INTEGER.match(text, at):
            out.append(("integer", int(m[0]), None, None, None))
        elif c == ">" or c and (c.isalnum() or c in "_~`([{"):
            at = _SPACE.match(text, at + (c == ">")).end()
            if c != ">" or _ID.match(text, at).end() > at:  # a bare sign repeats the id before
                base, at = read_id(text, at, base, base)
            out.append(("uuid", None, None, None, base))
            continue
        else:
            return out, at
        at = m.end()


class Broken(ValueError):
    """A frame that breaks, and its rows before that."""

    def __init__(self, why: str, rows: list):
        super().__init__(why)
        self.rows = rows


def frames(text: str, stream: bool = False, row=None) -> Iterator[list]:
    """The rows of each frame of a text; a frame ends at a full stop or the text's end, in a stream at a full stop alone. row makes them, log_row where it is not told. Broken says where one breaks."""
    rows: list = []
    try:
        yield from _frames(text, rows, stream, row or log_row)
    except (ValueError, KeyError, IndexError) as e:
        raise Broken(str(e), rows) from e


def _frames(text: str, rows: list, stream: bool, row) -> Iterator[list]:
    last, chunk, at, header, index = [ZERO] * 4, -1, 0, None, 0
    while True:
        at = _past_space(text, at)
        if at == len(text) or text[at] == ".":
            if at == len(text) and rows and stream:
                raise ValueError(f"no full stop at {at}")
            if rows or at < len(text):
                yield list(rows)
                rows.clear()
            if at == len(text):
                return
            last, chunk, at, header = [ZERO] * 4, -1, at + 1, None
            continue
        now, before, seen, start = list(last), ZERO, set(), at
        for k, sign in enumerate("*#@:"):
            at = _past_space(text, at)
            if text[at : at + 1] == sign:
                at += 1
                if _ID.match(text, at).end() > at:  # a bare sign repeats the key of the op before
                    now[k], at = read_id(text, at, last[k], before)
                seen.add(sign)
            before = now[k]
        payload, at = _atoms(text, at, now[1])
        at = _past_space(text, at)
        term = text[at : at + 1]
        at += term in ";,!?" and bool(term)
        if at == start:
            raise ValueError(f"frame breaks off at {at}")
        if term in ("!", "?") and term:
            header, chunk, index = (tuple(now), "value" if term == "!" else "query"), chunk + 1, 0
            rows.append(row(chunk, header[1], now, header[0], -1, payload))
        elif term == ";" or header is None or seen & {"*", "#"}:
            header, chunk = None, chunk + 1
            rows.append(row(chunk, "closed", now, None, 0, payload))
        elif seen or payload or term == ",":
            rows.append(row(chunk, header[1], now, header[0], index, payload))
            index += 1
        last = now


def log_row(chunk: int, kind: str, now: list, header: tuple | None, index: int, payload: list) -> dict:
    u = lambda x: dict(zip(("variety", "value", "variant", "version", "origin"), x))
    of = header or (ZERO,) * 4
    atoms = [dict(zip(("tag", "i", "f", "s"), a[:4]), u=u(a[4]) if a[4] else None) for a in payload]
    return {"chunk_no": chunk, "chunk_kind": kind, "type_id": u(now[0]), "object_id": u(now[1]), "header_op_id": u(of[2]), "header_ref_id": u(of[3]), "op_index": index, "op_id": u(now[2]), "ref_id": u(now[3]), "payload": atoms}


#: What plain_row tells, in order.
PLAIN = ("chunk_no", "chunk_kind", "type_id", "object_id", "header_op_id", "header_ref_id", "op_index", "op_id", "ref_id", "payload")


def plain_row(chunk: int, kind: str, now: list, header: tuple | None, index: int, payload: list) -> tuple:
    """What log_row tells, with ids and atoms as tuples."""
    of = header or (ZERO,) * 4
    return chunk, kind, now[0], now[1], of[2], of[3], index, now[2], now[3], payload


def _id_column(values: list, kind: pa.StructType) -> pa.Array:
    none = [v is None for v in values]
    columns = list(zip(*[ZERO if v is None else v for v in values])) or [()] * len(ZERO)
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind), mask=pa.array(none, pa.bool_()) if any(none) else None)


def _payload_column(values: list, kind: pa.ListType) -> pa.Array:
    of = kind.value_type
    *plain, u = list(zip(*[a for v in values for a in v or ()])) or [()] * len(of)
    atoms = pa.StructArray.from_arrays([*[pa.array(c, f.type) for c, f in zip(plain, of)], _id_column(u, of[len(of) - 1].type)], fields=list(of))
    ends = list(accumulate((len(v or ()) for v in values), initial=0))
    return pa.ListArray.from_arrays(pa.array([None if k < len(values) and values[k] is None else e for k, e in enumerate(ends)], pa.int32()), atoms, type=kind)


def batched(rows: Iterator[tuple[tuple | None, dict]], arrow: pa.Schema, n: int = 4096) -> Iterator[pa.RecordBatch]:
    """Plain rows (None: all null), each with its further columns, in Arrow batches of n, however they are spread over frames."""
    while some := list(islice(rows, n)):
        told = dict(zip(PLAIN, zip(*[(None,) * len(PLAIN) if r is None else r for r, _ in some])))
        columns = []
        for f in arrow:
            if f.name in some[0][1]:
                columns.append(pa.array([own[f.name] for _, own in some], f.type))
            elif f.name == "payload":
                columns.append(_payload_column(told[f.name], f.type))
            else:
                columns.append(_id_column(told[f.name], f.type) if pa.types.is_struct(f.type) else pa.array(told[f.name], f.type))
        yield pa.RecordBatch.from_arrays(columns, schema=arrow)


def pieces(batches: Iterator[pa.RecordBatch], n: int = 256) -> Iterator[dict]:
    """The rows of batches, so many at a time as Python values."""
    for b in batches:
        for i in range(0, b.num_rows, n):
            yield from b.slice(i, n).to_pylist()


def open_ops(text: str, row=None) -> list:
    """The rows of an open frame: ops that end with a comma or semicolon, each by default the next after and refering to the one before. row makes them, log_row where it is not told. Broken says where it breaks."""
    rows, at, before, row = [], 0, ZERO, row or log_row
    try:
        while (at := _past_space(text, at)) < len(text):
            now = [(*before[:1], min(before[1] + 1, types.MASK60), *before[2:]), before]
            for k, sign in enumerate("@:"):
                at = _past_space(text, at)
                if text[at : at + 1] == sign:
                    now[k], at = read_id(text, at + 1, ZERO, ZERO)
            payload, at = _atoms(text, at, now[0])
            at = _past_space(text, at)
            if text[at : at + 1] not in (",", ";"):
                raise ValueError(f"op without an end at {at}")
            rows.append(row(0, "open", [ZERO, ZERO, *now], None, len(rows), payload))
            at, before = at + 1, now[0]
    except (ValueError, KeyError, IndexError) as e:
        raise Broken(str(e), rows) from e
    return rows


def parsed_open(texts: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(keep, op_index, op_id, ref_id, payload, error): the ops of each text, an open frame, with error where it breaks: then the ops before it stay.

    Null texts give no rows.
    """
    keep = keep or []
    kept = texts.select(*keep).schema.simpleString()[len("struct<") : -1]
    schema: StructType = _parse_datatype_string(", ".join(filter(None, [kept, f"op_index int, op_id {types.UUID}, ref_id {types.UUID}, payload {types.PAYLOAD}, error string"])))
    arrow = to_arrow_schema(schema)

    def told(r: dict) -> Iterator[tuple]:
        own, why = {k: r[k] for k in keep} | {"error": None}, None
        try:
            ops = open_ops(r["text_"], plain_row)
        except Broken as e:
            ops, why = e.rows, str(e)
        for op in ops:
            yield op, own
        if why:
            yield None, own | {"error": why}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((row for r in pieces(batches) if r["text_"] is not None for row in told(r)), arrow)

    return texts.select(*keep, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def parsed_log(texts: DataFrame, text: str = "text", stream: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Log rows of each text's frames. Where a frame breaks, a row with its error stands for it and what follows; the frames before it stay.

    Null texts give no rows. frame_no counts within a text. stream: every
    frame must end with a full stop. keep: columns of the text's row to carry.
    """
    keep = keep or []
    kept = texts.select(*keep).schema.simpleString()[len("struct<") : -1]
    schema: StructType = _parse_datatype_string(", ".join(filter(None, [kept, f"{types.OPLOG}, error string"])))
    arrow = to_arrow_schema(schema)

    def told(t: str, own: dict) -> Iterator[tuple]:
        number = 0
        try:
            for number, frame in enumerate(frames(t, stream, plain_row)):
                of = own | {"frame_no": number, "error": None}
                for r in frame:
                    yield r, of
                number += 1
        except Broken as e:
            yield None, own | {"frame_no": number, "error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((row for r in pieces(batches) if r["text_"] for row in told(r["text_"], {k: r[k] for k in keep})), arrow)

    return texts.select(*keep, F.col(text).cast("string").alias("text_")).mapInArrow(run, schema)


def quoted(s: Column) -> Column:
    """A string atom: a JSON string in single quotes."""
    inner = F.regexp_replace(F.to_json(F.struct(s.alias("s"))), r'^\{"s":"|"\}$', "")
    return F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'"))


def event_id(op: Column, origin: Column) -> Column:
    """An epoch event id, version 2."""
    return types.uuid(11, op, 0, 2, origin)


def serialized(log: DataFrame, width: int = 4096) -> DataFrame:
    """(text) of log rows (object, op, field, value): a frame for each object and range of width op ids, so no frame is unbounded."""
    body = F.concat(F.lit("\t@"), ids.uuid_text(event_id(F.col("op"), F.col("object"))), F.lit(" :"), F.col("field"), F.lit(" ^"), F.col("value").cast("string"), F.lit(","))
    x = log.select("object", F.floor(F.col("op") / width).alias("part"), F.struct("op", body.alias("body")).alias("line"))
    head = F.concat(F.lit("*lww #"), ids.uuid_text(event_id(F.col("object"), F.lit(0))), F.lit(" @0 :0 !\n"))
    lines = F.array_join(F.transform(F.sort_array("lines"), lambda s: s["body"]), "\n")
    return x.groupBy("object", "part").agg(F.collect_list("line").alias("lines")).select(F.concat(head, lines, F.lit("\n.\n")).alias("text"))


def parsed(texts: DataFrame) -> DataFrame:
    """(object, op, field, value) of what serialized() wrote."""
    rows = parsed_log(texts).where("op_index >= 0")
    return rows.select(F.col("object_id.value").alias("object"), F.col("op_id.value").alias("op"), ids.encode60_short(F.col("ref_id.value")).alias("field"), F.col("payload")[0]["f"].alias("value"))
