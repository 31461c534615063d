"""The binary form of operation logs: big-endian blocks, each led by a type and a size of four bits.

Writing is a grouping of Column expressions on hexadecimal text. Reading
parses each binary value on its own; the tables of frames spread over the
cluster.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, _parse_datatype_string

from tidelog import types
from tidelog.functions import ids
from tidelog.sources.frames import KEYS, cut
from tidelog.sources.text import batched, log_row, pieces, plain_row

#: Fixed values of the format: the first bytes, and the types of blocks.
MAGIC = b"RON2"
CLOSED, REDUCED, HEADER, QUERY = 0, 1, 2, 3
TYPE, OBJECT, OP, REF = 4, 5, 6, 7
UUID, INTEGER, STRING, FLOAT = 12, 13, 14, 15
_LAST = 1 << 31


def _id_hex(u: Column) -> Column:
    word = lambda top, low: F.lpad(F.hex(F.shiftleft(top.cast("long"), 60).bitwiseOR(low)), 16, "0")
    return F.concat(word(u["variety"], u["value"]), word(u["variant"] * 4 + u["version"], u["origin"]))


def _string_hex(s: Column) -> Column:
    n = F.octet_length(s)
    extended = F.when(n < 128, F.lpad(F.hex(n), 2, "0")).otherwise(F.lpad(F.hex(n.cast("long") + _LAST), 8, "0"))
    return F.concat(F.lit(f"{STRING:X}"), F.when((n > 0) & (n < 16), F.hex(n)).otherwise(F.concat(F.lit("0"), extended)), F.hex(F.encode(s, "UTF-8")))


@F.pandas_udf(ArrayType(StringType()))
def _float_hex(values: pd.Series) -> pd.Series:
    """The bits of doubles: no built-in function shows them."""
    return values.map(lambda a: None if a is None else [None if f is None else struct.pack(">d", f).hex().upper() for f in a])


def _atoms_hex(payload: Column, floats: Column) -> Column:
    def one(a: Column, f: Column) -> Column:
        return (
            F.when(a["tag"] == "uuid", F.concat(F.lit(f"{UUID:X}0"), _id_hex(a["u"])))
            .when(a["tag"] == "string", _string_hex(a["s"]))
            .when(a["tag"] == "integer", F.concat(F.lit(f"{INTEGER:X}8"), F.lpad(F.hex(ids.zigzag_encode(a["i"])), 16, "0")))
            .otherwise(F.concat(F.lit(f"{FLOAT:X}8"), f))
        )

    return F.array_join(F.zip_with(payload, floats, one), "")


def serialized(log: DataFrame, key: list[str], width: int = 256) -> DataFrame:
    """(key, data) of log rows (types.OPLOG): each part of a frame as one binary frame.

    Reduced ops carry two keys, as readers of the format expect; cut() says
    how long frames are parted.
    """
    x = cut(log, key, width).withColumn("floats", _float_hex(F.transform("payload", lambda a: a["f"])))
    body = (F.col("op_index") >= 0) & (F.col("chunk_kind") != "closed")
    kind = F.when(body, REDUCED).when(F.col("chunk_kind") == "closed", CLOSED).when(F.col("chunk_kind") == "query", QUERY).otherwise(HEADER)
    keys = [F.concat(F.lit(f"{code}0"), _id_hex(F.col(c))) for code, c in zip((TYPE, OBJECT, OP, REF), KEYS.values())]
    block = F.concat(kind.cast("string"), F.lit("0"), F.when(body, "").otherwise(F.concat(*keys[:2])), *keys[2:], _atoms_hex(F.col("payload"), F.col("floats")))
    ops = x.select(*key, "part", "chunk_no", F.struct("op_index", block.alias("hex")).alias("op"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("op")), lambda s: s["hex"]), "")
    chunks = ops.groupBy(*key, "part", "chunk_no").agg(joined.alias("hex"))
    framed = chunks.groupBy(*key, "part").agg(F.sort_array(F.collect_list(F.struct("chunk_no", "hex"))).alias("chunks"))
    more = F.size("chunks") - 1
    size = lambda c, i: F.length(c["hex"]).cast("long") / 2 + F.when(i < more, F.lit(_LAST)).otherwise(0)
    text = F.array_join(F.transform("chunks", lambda c, i: F.concat(F.lpad(F.hex(size(c, i).cast("long")), 8, "0"), c["hex"])), "")
    return framed.select(*key, F.unhex(F.concat(F.lit(MAGIC.hex()), text)).alias("data"))


def _block(data: bytes, at: int) -> tuple[int, int, int]:
    """(type, size, where its bytes start) of the block at a place."""
    kind, size = data[at] >> 4, data[at] & 15
    at += 1
    if size or kind <= QUERY:
        return kind, size, at
    if kind != STRING:
        return kind, 16, at
    if data[at] & 128:
        return kind, int.from_bytes(data[at : at + 4]) & (_LAST - 1), at + 4
    return kind, data[at], at + 1


def _id(data: bytes) -> tuple:
    high, low = struct.unpack(">QQ", data)
    cut60 = types.MASK60
    return high >> 60, high & cut60, low >> 62, low >> 60 & 3, low & cut60


def _op(data: bytes, at: int, end: int) -> tuple[int, dict[int, tuple], list[tuple], int]:
    """(kind, keys by type, atoms, the next place) of the op at a place; a reduced op may carry two keys or four."""
    kind, size, at = _block(data, at)
    if kind > QUERY or size:
        raise ValueError(f"no op at {at - 1}")
    keys, atoms = {}, []
    while at < end and data[at] >> 4 > QUERY:
        code, size, start = _block(data, at)
        at = start + size
        if at > end:
            raise ValueError(f"block ends beyond its chunk at {start}")
        raw = data[start:at]
        if TYPE <= code <= REF:
            keys[code] = _id(raw)
        elif code == UUID:
            atoms.append(("uuid", None, None, None, _id(raw)))
        elif code == INTEGER and size == 8:
            v = int.from_bytes(raw)
            atoms.append(("integer", v >> 1 ^ -(v & 1), None, None, None))
        elif code == STRING:
            atoms.append(("string", None, None, raw.decode(), None))
        elif code == FLOAT and size == 8:
            atoms.append(("float", None, struct.unpack(">d", raw)[0], None, None))
        else:
            raise ValueError(f"unknown block of type {code} and size {size} at {start}")
    if not {OP, REF} <= keys.keys() or kind != REDUCED and not {TYPE, OBJECT} <= keys.keys():
        raise ValueError(f"op without its keys before {at}")
    return kind, keys, atoms, at


def frame(data: bytes, row=None) -> list:
    """The rows of a binary frame, made by row, by log_row where that is not told; ValueError says where it breaks."""
    row = row or log_row
    if data[:4] != MAGIC:
        raise ValueError(f"unsupported first bytes {data[:4]!r}")
    rows, at, chunk, more = [], 4, 0, True
    while more:
        if at + 4 > len(data):
            raise ValueError(f"no chunk size at {at}")
        size = int.from_bytes(data[at : at + 4])
        more, size, at = size >= _LAST, size & (_LAST - 1), at + 4
        if not size and not more:
            break
        end = at + size
        if end > len(data):
            raise ValueError(f"chunk of {size} bytes at {at} goes beyond the end")
        kind, keys, atoms, at = _op(data, at, end)
        if kind == REDUCED:
            raise ValueError(f"reduced op without a chunk before {at}")
        if kind == CLOSED and at != end:
            raise ValueError(f"chunk of {size} bytes has more than its op at {at}")
        now = [keys[k] for k in (TYPE, OBJECT, OP, REF)]
        name, header = {CLOSED: "closed", HEADER: "value", QUERY: "query"}[kind], None if kind == CLOSED else tuple(now)
        rows.append(row(chunk, name, now, header, 0 if kind == CLOSED else -1, atoms))
        index = 0
        while at < end:
            kind, keys, atoms, at = _op(data, at, end)
            if kind != REDUCED:
                raise ValueError(f"op of kind {kind} inside a chunk before {at}")
            rows.append(row(chunk, name, [*now[:2], keys[OP], keys[REF]], header, index, atoms))
            index += 1
        chunk += 1
    if at != len(data):
        raise ValueError(f"bytes after the frame at {at}")
    return rows


def parsed_log(frames: DataFrame, data: str = "data") -> DataFrame:
    """Log rows of each binary frame; a broken one gives one row with its error and no others. Nulls give no rows."""
    schema = _parse_datatype_string(f"{types.OPLOG}, error string")
    arrow = to_arrow_schema(schema)

    own = {"frame_no": 0, "error": None}

    def told(raw: bytes) -> list[tuple]:
        try:
            return [(r, own) for r in frame(raw, plain_row)]
        except (ValueError, IndexError, struct.error) as e:
            return [(None, own | {"error": str(e)})]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((r for raw in pieces(batches) if raw["data_"] is not None for r in told(raw["data_"])), arrow)

    return frames.select(F.col(data).cast("binary").alias("data_")).mapInArrow(run, schema)
