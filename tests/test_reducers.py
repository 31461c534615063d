"""Semilattice laws on random logs, and worked cases."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import reducers, sequences, stores, views


def log(spark, seed, n=200):
    r = random.Random(seed)
    return spark.createDataFrame([(r.randrange(5), r.choice("abc"), r.randrange(40), float(r.randrange(9))) for _ in range(n)], "object long, field string, op long, value double")


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()))


def lww(x):
    return reducers.lww(x, ["object", "field"], "op", ["value"])


@pytest.mark.parametrize("seed", range(3))
def test_lww_laws(spark, seed):
    a, b, c = (log(spark, 10 * seed + k, 60) for k in range(3))
    whole = rows(lww(a.unionByName(b).unionByName(c)))
    assert rows(reducers.merge([lww(a), lww(b), lww(c)], lww)) == whole
    assert rows(reducers.merge([lww(c), lww(a), lww(b)], lww)) == whole
    assert rows(reducers.merge([lww(a), lww(a)], lww)) == rows(lww(a))


def test_orset_remove_before_add_and_tombstones(spark):
    x = spark.createDataFrame([(1, 5, 2, None), (1, 2, 0, "p"), (1, 3, 0, "q"), (1, 9, 2, "p")], "object long, op long, ref long, value string")
    state = reducers.orset(x, ["object"], "op", "ref", ["value"])
    assert rows(state.select("item", "op", "ref", "value")) == [(2, 9, 2, "p"), (3, 3, 0, "q")]
    assert [r["item"] for r in reducers.alive(state, "ref").collect()] == [3]


def test_version_vectors(spark):
    x = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 1), ("b", 3), ("c", 4)], "replica string, t long")
    assert rows(reducers.version_vector(x, [], "replica", "t")) == [("a", 2), ("b", 3), ("c", 4)]


def test_tree_order_deep_and_orphans(spark):
    deep = [(1, i, i - 1) for i in range(1, 3001)] + [(2, 1, 0), (2, 3, 1), (2, 2, 1), (2, 9, 8), (2, 3, 1)]
    got = sequences.tree_order(spark.createDataFrame(deep, "object long, op long, parent long")).collect()
    assert [r["op"] for r in sorted((r for r in got if r["object"] == 1), key=lambda r: r["pos"])] == list(range(1, 3001))
    assert [r["op"] for r in sorted((r for r in got if r["object"] == 2), key=lambda r: r["pos"])] == [1, 3, 2]


def test_concurrent_inserts_stand_by_descending_id(spark):
    x = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 1)], "object long, op long, ref long")
    assert [r["op"] for r in sequences.list_order(x).orderBy("pos").collect()] == [1, 3, 2]


def test_depths_of_a_long_chain(spark):
    got = sequences.depths(spark.createDataFrame([(1, i, i - 1) for i in range(1, 201)], "object long, op long, parent long"), "object", "op", "parent")
    assert rows(got.select("op", "depth")) == [(i, i) for i in range(1, 201)]


@pytest.mark.parametrize("width", [1, 3, 7, 1000])
def test_patch_runs_whatever_the_ranges(spark, width):
    r = random.Random(3)
    made = [(i * 2, r.choice("ab") if i % 40 else "c", 1) for i in range(300)]
    want, prev = [], None
    for op, o, v in made:
        if o != prev:
            want.append([op, op, o, 0, 0])
        want[-1][1], want[-1][3], want[-1][4], prev = op, want[-1][3] + 1, want[-1][4] + v, o
    got = stores.patch_runs(spark.createDataFrame(made, "op long, object string, v long"), "object", "op", "v", width)
    assert sorted(map(tuple, got.select("first_op", "last_op", "object", "n_ops", "total").collect())) == sorted(map(tuple, want))


def test_append_is_idempotent(spark):
    a, b = log(spark, 1).dropDuplicates(["op"]), log(spark, 2)
    once = stores.appended(a, b, "op")
    assert once.count() == once.select("op").distinct().count() == stores.appended(once, b, "op").count()


def test_unknown_strategy():
    with pytest.raises(ValueError):
        views.strategy("average", "value", "op")


def test_under_path(spark):
    x = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"]), (3, ["b", "a"]), (4, [])], "op long, payload array<string>")
    assert sorted((r["op"], tuple(r["payload"])) for r in views.under_path(x, "payload", ["a"]).collect()) == [(1, ("b",)), (2, ())]


def test_empty_logs(spark):
    empty = log(spark, 0, 1).limit(0)
    assert lww(empty).count() == 0
    assert reducers.orset(empty.withColumn("ref", F.lit(0).cast("long")), ["object"], "op", "ref", ["value"]).count() == 0
    assert sequences.tree_order(empty.withColumn("parent", F.lit(0).cast("long"))).count() == 0
