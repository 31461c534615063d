"""Parsed rows become Arrow columns without a dict for each id."""

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidelog import types
from tidelog.sources import text

SAID = "*lww #a+b @1+a :0 ! 'x' 5 >c+d\n\t@2+a :f ^1.5,\n\t:g,\n*set #c ?\n.\n*rga #d @4+a ; \n."


def test_columns_are_those_of_dicts(spark):
    arrow = to_arrow_schema(_parse_datatype_string(f"{types.OPLOG}, error string"))
    own = {"frame_no": 3, "error": None}
    plain = [(r, own) for f in text.frames(SAID, row=text.plain_row) for r in f]
    dicts = [r | own for f in text.frames(SAID) for r in f]
    broken = own | {"error": "why"}
    got = pa.Table.from_batches(text.batched(iter([*plain, (None, broken)]), arrow, 2))
    want = pa.Table.from_pylist([*dicts, dict.fromkeys(arrow.names) | broken], arrow)
    assert got.schema == arrow and got.to_pylist() == want.to_pylist() and len(dicts) == 6


def test_no_dicts_are_made(monkeypatch):
    made = []
    monkeypatch.setattr(text, "log_row", lambda *a: made.append(a))
    rows = list(text.frames(SAID, row=text.plain_row))
    assert [len(f) for f in rows] == [5, 1] and not made
