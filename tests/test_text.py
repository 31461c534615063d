"""The text form: ids in their spellings, atoms, inherited keys, broken frames.

Spellings of ids and frames are fixed values of the format.
"""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids
from tidelog.sources import text

ZERO = text.ZERO


def read(s, same=ZERO, before=ZERO):
    return text.read_id(s, 0, same, before)[0]


def one(s):
    return next(iter(text.frames(s)))


@pytest.mark.parametrize("spelling", ["A/LED", "ALED0000000", "ALED0000000$", "ALED000000000000000000"])
def test_spellings_of_one_id(spelling):
    assert read(spelling) == (10, text._word("LED"), 0, 0, 0)


def test_delta_forms():
    base = (0, text._word("B3QCFGMHK1"), 0, 2, text._word("2005CRP400"))
    assert read("(abc", base) == (0, text._word("B3QCabc"), 0, 2, base[4])
    assert read("`)2", ZERO, base)[1] == text._word("B3QCFGMHK2")
    assert read("time", base) == (0, text._word("time"), 0, 0, 0)
    assert read("1+", base) == (0, text._word("1"), 0, 2, base[4])


def test_keys_are_inherited_and_bodies_nest():
    rows = one("*lww#test4@2:1!\n  :a 'A1'\n  :b 'B1'\n*lww#test4@3:1! :a 'A2',")
    assert [r["chunk_no"] for r in rows] == [0, 0, 0, 1, 1]
    assert [r["op_index"] for r in rows] == [-1, 0, 1, -1, 0]
    assert {r["op_id"]["value"] for r in rows[:3]} == {text._word("2")}
    assert rows[2]["payload"][0]["s"] == "B1"


def test_raw_ops_follow_each_other():
    rows = one("*lww#raw@1:one=1;@2:two^2.0;:three'три';")
    assert [r["chunk_kind"] for r in rows] == ["closed"] * 3
    assert [(p["tag"], p["i"], p["f"], p["s"]) for r in rows for p in r["payload"]] == [("integer", 1, None, None), ("float", None, 2.0, None), ("string", None, None, "три")]
    assert rows[2]["op_id"]["value"] == text._word("2")


def test_composite_names_and_extremes():
    rows = one("*lww#array@1:0! :0%0 =0, :)1%0 =-9223372036854775808")
    assert rows[2]["ref_id"] == dict(zip(("variety", "value", "variant", "version", "origin"), (0, 1, 0, 1, 0)))
    assert rows[2]["payload"][0]["i"] == -(1 << 63)


def test_escapes():
    (row,) = one(r"*lww#a@1:s 'it\'s \n Ж \"quoted\"';")
    assert row["payload"][0]["s"] == 'it\'s \n Ж "quoted"'


def test_empty_state_and_several_frames():
    got = list(text.frames("*set #id !\n.\n*set #id ?."))
    assert [[r["chunk_kind"] for r in f] for f in got] == [["value"], ["query"]]


def test_broken_frames_become_error_rows(spark):
    df = spark.createDataFrame([("*lww#a@1:x=1; ]]",), (None,), ("",), ("*lww#a@1:x=1;",)], "text string")
    rows = text.parsed_log(df).collect()
    assert sum(r["error"] is not None for r in rows) == 1
    assert sum(r["error"] is None for r in rows) == 1


def test_ids_round_trip_and_keep_order(spark):
    r = random.Random(1)
    made = [(r.randrange(16), r.randrange(1 << 60), 0, r.randrange(4), r.randrange(1 << 60)) for _ in range(200)] + [ZERO]
    df = spark.createDataFrame(made, "variety int, value long, variant int, version int, origin long")
    u = types.uuid(*[F.col(c) for c in df.columns])
    rows = df.select(ids.uuid_text(u).alias("t"), ids.sortable(u).alias("s"), ids.decode60(ids.encode60(F.col("value"))).alias("back"), "value").collect()
    assert [read(x["t"]) for x in rows] == made
    assert [read(x["s"]) for x in rows] == made
    assert sorted(range(201), key=lambda i: made[i]) == sorted(range(201), key=lambda i: rows[i]["s"])
    assert all(x["back"] == x["value"] for x in rows)


def test_string_atoms(spark):
    said = ["it's", 'a "b"', "c\\d", "", "Ж\n"]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select(text.quoted(F.col("s")).alias("q")).collect()
    assert [text._atoms(r["q"], 0, ZERO)[0][0][3] for r in rows] == said
