"""Streams that stop and go on: the state of all batches, whatever was done twice; runs that grow by levels."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import reducers
from tidelog.streaming import live, states

SCHEMA = "object long, field string, op long, value long"


def reduce(rows):
    return reducers.lww(rows, ["object", "field"], "op", ["value"])


def latest(rows):
    out = {}
    for o, f, op, v in rows:
        out[o, f] = max(out.get((o, f), (-1, None)), (op, v))
    return sorted((*k, *v) for k, v in out.items())


@pytest.fixture
def files(spark, tmp_path):
    """Six files of ops, and all their rows; some ops come in two files."""
    r = random.Random(5)
    rows = [[(r.randrange(5), r.choice("ab"), op, op * 2) for op in r.sample(range(60), 15)] for _ in range(6)]
    rows[4] += rows[0][:3]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/log.parquet/{i}")
    return [x for part in rows for x in part]


def stream(spark, tmp_path):
    return live.source(spark, f"{tmp_path}/in", "log", spark.createDataFrame([], SCHEMA).schema)


@pytest.mark.parametrize("fan", [2, 4])
def test_stops_between_batches(spark, tmp_path, files, fan):
    schema = reduce(spark.createDataFrame([], SCHEMA)).schema
    state = states.State(spark, f"{tmp_path}/state", reduce, schema, fan)
    assert state.read().collect() == []
    seen = []

    def fail(number):
        seen.append(number)
        if len(seen) in (1, 3, 4):
            raise InterruptedError("stopped")  # the batch is in the state, the stream does not know

    for _ in range(3):
        with pytest.raises(Exception, match="stopped"):
            states.kept_up(stream(spark, tmp_path), state, f"{tmp_path}/place", fail)
    states.kept_up(stream(spark, tmp_path), states.State(spark, f"{tmp_path}/state", reduce, schema, fan), f"{tmp_path}/place", seen.append)
    assert seen == [0, 0, 1, 1, 1, 2, 3, 4, 5]
    assert sorted(map(tuple, state.read().select("object", "field", "op", "value").collect())) == latest(files)
    levels = [level for _, level in state.last()["runs"]]
    assert levels == sorted(levels, reverse=True) and len(levels) < 6
    states.kept_up(stream(spark, tmp_path), state, f"{tmp_path}/place")
    assert state.last()["batch"] == 5


def test_runs_grow_by_levels_and_old_ones_go(spark, tmp_path):
    schema = reduce(spark.createDataFrame([], SCHEMA)).schema
    state = states.State(spark, str(tmp_path), reduce, schema, 2)
    for n in range(9):
        assert state.take(spark.createDataFrame([(n % 3, "a", n, n)], SCHEMA), n)
        assert not state.take(spark.createDataFrame([(9, "a", 99, 99)], SCHEMA), n)
        os.makedirs(f"{tmp_path}/runs/left-{n}")  # of a writer that stopped
    assert [level for _, level in state.last()["runs"]] == [3, 0]
    assert len(os.listdir(f"{tmp_path}/commits")) == 3 and len(os.listdir(f"{tmp_path}/runs")) < 8
    assert sorted((r["object"], r["op"]) for r in state.read().collect()) == [(0, 6), (1, 7), (2, 8)]


def test_log_of_a_stream_is_that_of_its_table(spark, tmp_path, files):
    got = live.appended(stream(spark, tmp_path), "op", f"{tmp_path}/log").collect()
    assert sorted(r["op"] for r in got) == sorted({x[2] for x in files})
    again = live.appended(stream(spark, tmp_path), "op", f"{tmp_path}/log").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    one = spark.createDataFrame([(1, "a", 7, 1), (1, "b", 7, 0), (1, "a", 8, 2)], SCHEMA)
    one.coalesce(1).write.parquet(f"{tmp_path}/two/in/log.parquet")
    got = live.appended(live.source(spark, f"{tmp_path}/two/in", "log", one.schema), "op", f"{tmp_path}/two/log")
    assert sorted(map(tuple, got.select("op", "field").where(F.col("op") == 7).collect())) == [(7, "b")]
