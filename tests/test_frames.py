"""The delta-coded and the binary form: round trips, sizes, cuts, broken input."""

import struct

import pytest
from pyspark.sql import functions as F

from tidelog.sources import binary, frames, text

LOG = r"""*lww#test4@2:1! :a 'A1' :b >abc >abcd >abcdefg >abcdeff >abcdeff 5 -6.5 ^1e300 'it\'s "q"' '', :c,
*lww#test4@3:1! :a 'Ж', *set #id ? *rga#B3QCFGMHK1+2005CRP400@B3QCFGMHK1+2005CRP400:0 -9223372036854775808;
@B3QCFGMHK2+2005CRP400:B3QCFGMHK1+2005CRP400 >B3QCFGMHK4+2005CRP400 >A/LED;
*rga#list! @1'a' @3'c' @2:9'b' .
*set #other@1! 'a string of more than fifteen bytes', *set#empty!."""


def rows(df):
    return sorted((tuple(r) for r in df.drop("error", "frame_no", "k").collect()), key=str)


@pytest.fixture(scope="module")
def log(spark):
    return text.parsed_log(spark.createDataFrame([(LOG,)], "text string")).drop("error").persist()


def test_delta_round_trip(spark, log):
    out = frames.delta_coded(log, ["frame_no"])
    back = text.parsed_log(out)
    assert back.where("error IS NOT NULL").isEmpty()
    assert rows(back) == rows(log)
    first = out.where("frame_no = 0").first()["text"]
    assert ">abcd >(efg >{f >abcdeff" in first and "\t@`)1" not in first.split("\n")[0]


def test_bare_keys_repeat_the_op_before():
    (frame,) = text.frames("*rga#x! @1 'A', @ 'B', > 'c',")
    assert [r["op_id"]["value"] for r in frame[1:3]] == [text._word("1")] * 2


def test_binary_round_trip(spark, log):
    out = binary.serialized(log, ["frame_no"])
    back = binary.parsed_log(out)
    assert back.where("error IS NOT NULL").isEmpty()
    assert rows(back) == rows(log)


def test_binary_bytes(spark):
    log = text.parsed_log(spark.createDataFrame([("*0#0@0:0 -1 'ab' 1.5;",)], "text string"))
    data = bytes(binary.serialized(log, ["frame_no"]).first()["data"])
    keys = b"".join(bytes([16 * k]) + bytes(16) for k in (4, 5, 6, 7))
    block = b"\0" + keys + b"\xd8" + (1).to_bytes(8) + b"\xe2ab" + b"\xf8" + struct.pack(">d", 1.5)
    assert data == b"RON2" + len(block).to_bytes(4) + block


def test_four_keys_in_a_reduced_op():
    key = lambda k: bytes([16 * k]) + bytes(16)
    chunk = b"\x20" + b"".join(map(key, (4, 5, 6, 7))) + b"\x10" + b"".join(map(key, (4, 5, 6, 7))) + b"\xe0\x00"
    got = binary.frame(b"RON2" + len(chunk).to_bytes(4) + chunk)
    assert [(r["op_index"], len(r["payload"])) for r in got] == [(-1, 0), (0, 1)]


def test_broken_binary_becomes_errors(spark, log):
    good = bytes(binary.serialized(log.where("frame_no = 1"), ["frame_no"]).first()["data"])
    bad = [good[:n] for n in range(0, len(good), 7)] + [b"XXXX" + good[4:], good + b"!"]
    df = spark.createDataFrame([(bytearray(b),) for b in bad] + [(None,), (bytearray(b"RON2\0\0\0\0"),)], "data binary")
    out = binary.parsed_log(df).collect()
    assert len(out) == len(bad) and all(r["error"] for r in out)


def test_long_frames_are_cut(spark):
    body = ", ".join(f"@{i:03d}1 '{i}'" for i in range(50))
    log = text.parsed_log(spark.createDataFrame([(f"*rga#list! {body}, *set#s@0:p! {body}, *lww#x@1:f 5;",)], "text string")).drop("error")
    parts = text.parsed_log(frames.delta_coded(log, ["frame_no"], 16))
    assert parts.where("op_index >= 0").count() == 101
    heads = parts.where("op_index < 0").select("type_id.value", "ref_id.value").collect()
    assert len(heads) == 8
    assert {r[1] for r in heads if r[0] == text._word("set")} == {text._word("p")}
    assert {r[1] for r in heads if r[0] == text._word("rga")} == {0} | {text._word(f"{i:03d}1") for i in (15, 31, 47)}
    assert rows(binary.parsed_log(binary.serialized(log, ["frame_no"], 16))) == rows(parts)


def test_nothing(spark, log):
    assert frames.delta_coded(log.where("false"), ["frame_no"]).isEmpty()
    assert binary.serialized(log.where("false"), ["frame_no"]).isEmpty()
    assert frames.cut(log, ["frame_no"]).where(F.col("part.slice") > 0).isEmpty()
