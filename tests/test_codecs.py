"""Open frames, floats that are no numbers, file names, folders, list merges, strict reads."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import types
from tidelog.functions import ids, parsing, times
from tidelog.operators import edits, lists, views
from tidelog.sources import binary, folders, frames, text


def test_floats_that_are_no_numbers_survive(spark):
    log = text.parsed_log(spark.createDataFrame([("*lww#x@1! :a ^NaN :b ^Infinity :c ^-Infinity :d ^1e300 :e NaN,",)], "text string")).drop("error")
    want = [("float", "NaN"), ("float", "inf"), ("float", "-inf"), ("float", "1e+300"), ("uuid", "None")]
    told = lambda x: [(a["tag"], str(a["f"]) if a["f"] is None or a["f"] != a["f"] or abs(a["f"]) > 1e301 else f"{a['f']:g}") for a in (r["payload"][0] for r in sorted(x.where("op_index >= 0").collect(), key=lambda r: r["ref_id"]["value"]))]
    assert [(t, f.replace("nan", "NaN")) for t, f in told(log)] == want
    again = text.parsed_log(frames.delta_coded(log, ["frame_no"]))
    assert told(again) == told(log)
    assert told(binary.parsed_log(binary.serialized(log, ["frame_no"]))) == told(log)


def test_open_ops_follow_each_other():
    rows = text.open_ops("@1+a :lww, 'x' 1, @9+a 'y', :5+b >c;")
    word = text._word
    assert [r["op_id"]["value"] for r in rows] == [word("1"), word("1") + 1, word("9"), word("9") + 1]
    assert [r["ref_id"]["value"] for r in rows] == [word("lww"), word("1"), word("1") + 1, word("5")]
    with pytest.raises(text.Broken) as e:
        text.open_ops("@1+a :lww, @2+a 'x'")
    assert len(e.value.rows) == 1
    assert text.open_ops("") == []


def test_frames_of_a_stream_need_their_full_stop(spark):
    x = spark.createDataFrame([("*lww#x@1:a=1; .",), ("*lww#x@1:a=1;",)], "text string")
    assert text.parsed_log(x, stream=True).where("error IS NULL").count() == 1
    assert text.parsed_log(x).where("error IS NULL").count() == 2


def test_file_names_of_any_id(spark):
    r = random.Random(3)
    made = [(r.randrange(16), r.randrange(1 << 60), r.randrange(4), r.randrange(4), r.randrange(1 << 60)) for _ in range(200)] + [(0, 0, 0, 0, 0), (15, (1 << 60) - 1, 3, 3, (1 << 60) - 1)]
    u = types.uuid(*[F.col(c) for c in ("a", "b", "c", "d", "e")])
    x = spark.createDataFrame(made, "a int, b long, c int, d int, e long").select(ids.file_name(u).alias("name"), ids.sortable(u).alias("s"))
    got = x.select(ids.from_file_name(F.lower("name")).alias("u"), ids.from_sortable(F.col("s")).alias("v"), ids.is_file_name(F.col("name")).alias("ok"), ids.is_file_name(F.lower("name")).alias("low")).collect()
    assert [tuple(g["u"]) for g in got] == [tuple(g["v"]) for g in got] == made and all(g["ok"] for g in got)
    bad = spark.createDataFrame([("",), ("X-1",), ("12",), ("1-2-3",), (None,)], "s string").select(ids.from_file_name(F.col("s")).alias("u")).collect()
    assert [g["u"] for g in bad] == [None] * 5


def test_folder_store(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    one = spark.createDataFrame([(1, 5, 0, "a"), (1, 5, 1, "b"), (2, 6, 0, "c")], "object long, patch long, op_index int, s string")
    atom = F.struct(F.lit("string").alias("tag"), F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("double").alias("f"), F.col("s"), F.lit(None).cast(types.UUID).alias("u"))
    op = types.uuid(0, F.col("patch") * 10 + F.col("op_index"), 0, 2, 1)
    ops = one.select(types.uuid(0, F.col("object"), 0, 2, 1).alias("object_id"), types.uuid(0, F.col("patch") * 10 + 9, 0, 2, 1).alias("patch_id"), "op_index", op.alias("op_id"), types.uuid().alias("ref_id"), F.array(atom).alias("payload"))
    folders.append_patches(ops, path)
    folders.append_patches(ops.where("op_id.value >= 60"), path)  # again: the same file
    assert sorted(p.name for p in (tmp_path / "store").rglob("log/*") if not p.name.startswith(".")) == sorted(x["n"] for x in ops.select(ids.file_name(F.col("patch_id")).alias("n")).distinct().collect())
    assert sorted(r["payload"][0]["s"] for r in folders.load_log(spark, path).collect()) == ["a", "b", "c"]
    seen = spark.createDataFrame([(1, 50)], "replica long, time long")
    assert sorted(r["payload"][0]["s"] for r in folders.load_log(spark, path, seen).collect()) == ["b", "c"]
    assert sorted(r["object_id"]["value"] for r in folders.objects(spark, path).collect()) == [1, 2]


def test_long_lists_merge_in_linear_time():
    n = 100_000
    assert lists.fixed_point([(0, [1])] + [(i, [i + 1]) for i in range(1, n)], 0) == {0: list(range(1, n + 1))}


def test_strict_reads_and_edits(spark):
    x = spark.createDataFrame([(1, 1), (2, None)], "k long, v long")
    assert x.where("k = 1").select(views.required(F.col("v"), "value").alias("v")).collect() == [(1,)]
    with pytest.raises(Exception, match="no value"):
        x.select(views.required(F.col("v"), "value")).collect()
    known, ops = spark.createDataFrame([(1, 5)], "object long, op long"), spark.createDataFrame([(1, 9, 5)], "object long, op long, ref long")
    assert edits.placed_after(ops, known, ["object"]).count() == 1
    with pytest.raises(Exception, match="no op 5"):
        edits.placed_after(ops, known.where("false"), ["object"]).collect()


def test_payloads_as_values(spark):
    said = [("true", True), ("false", False), ("some true", None), ("1", None), ("", None)]
    x = spark.createDataFrame([(t,) for t, _ in said], "t string").select(parsing.parse_payload(F.col("t")).alias("p"))
    assert [r[0] for r in x.select(views.boolean(F.col("p"))).collect()] == [v for _, v in said]
    assert [r[0] for r in x.select(views.boolean(views.optional(F.col("p")))).collect()] == [True, False, True, None, None]


def test_calendar_clips_and_refuses(spark):
    c = lambda *v: times.calendar_value(*[F.lit(x) for x in v])
    row = spark.range(1).select(c(2012, 2, 29).isNotNull(), c(2013, 2, 29).isNull(), c(2009, 1, 1).isNull(), c(2351, 5, 1).isNull(), c(2010, 1, 1, 24).isNull()).first()
    assert all(row)
