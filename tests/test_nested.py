"""Nested objects: read with cycles and missing ones, written and read again."""

import pytest
from pyspark.sql import functions as F

from tidelog.operators import nested
from tidelog.operators.nested import Object, Objects

PERSON = Object({"name": "lww", "tags": "set"})
POST = Object({"title": "lww", "author": PERSON, "replies": Objects({"title": "lww", "author": PERSON, "replies": Objects({"title": "lww", "best": "max"})})})
LOG = "object long, field string, op long, value string, ref long"


def plain(rows, object, type, path=()):
    if object in path:
        return {"object": object, "status": "cycle"} | dict.fromkeys(type.fields)
    own = sorted((r for r in rows if r[0] == object), key=lambda r: r[2])
    if not own:
        return {"object": object, "status": "missing"} | dict.fromkeys(type.fields)
    out = {"object": object, "status": "ok"}
    for f, kind in type.fields.items():
        values = [r[3] for r in own if r[1] == f]
        refs = [r[4] for r in own if r[1] == f and r[4] is not None]
        if isinstance(kind, Objects):
            out[f] = [plain(rows, x, kind, (*path, object)) for x in dict.fromkeys(refs)]
        elif isinstance(kind, Object):
            out[f] = plain(rows, refs[-1], kind, (*path, object)) if refs else None
        elif kind == "set":
            out[f] = values
        else:
            out[f] = {"lww": lambda v: v[-1], "max": max}[kind](values) if values else None
    return out


def test_read_as_plainly(spark):
    rows = [
        (1, "title", 1, "old", None), (1, "title", 2, "new", None), (1, "author", 3, None, 10), (1, "author", 4, None, 11), (1, "replies", 5, None, 2), (1, "replies", 6, None, 3), (1, "replies", 7, None, 2), (1, "replies", 8, None, 99),
        (2, "title", 9, "re", None), (2, "replies", 10, None, 1), (2, "replies", 11, None, 3), (2, "author", 12, None, 98), (3, "title", 13, None, None), (3, "best", 14, "4", None), (3, "best", 15, "9", None), (3, "replies", 16, None, 3),
        (11, "name", 17, "Ada", None), (11, "tags", 18, "a", None), (11, "tags", 19, "b", None), (4, "author", 20, None, 4),
    ]
    log = spark.createDataFrame(rows, LOG)
    roots = spark.createDataFrame([(1,), (2,), (3,), (4,), (77,), (1,), (None,)], "object long")
    got = {r["object"]: r.asDict(True) for r in nested.read(log, roots, POST).collect()}
    assert got == {o: plain(rows, o, POST) for o in (1, 2, 3, 4, 77)}
    said = str(got)
    assert "cycle" in said and "missing" in said
    assert nested.read(log.limit(0), roots.limit(0), POST).collect() == []


def test_names_of_fields():
    with pytest.raises(ValueError, match="status"):
        Object({"Status": "lww"})


def test_closure(spark):
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5), (6, None), (1, 2)], "object long, ref long")
    roots = spark.createDataFrame([(1,), (5,), (6,)], "object long")
    assert sorted(map(tuple, nested.closure(roots, refs).collect())) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (5, 5, 0), (6, 6, 0)]


def test_written_is_read_again(spark):
    kind = "k long, title string, author struct<name: string, tags: array<string>>, replies array<struct<title: string, author: struct<name: string, tags: array<string>>, replies: array<struct<title: string, best: string>>>>"
    rows = [
        (1, "a", {"name": "Ada", "tags": ["x", "y"]}, [{"title": "b", "author": None, "replies": [{"title": "c", "best": "1"}, {"title": None, "best": None}]}, {"title": None, "author": {"name": None, "tags": []}, "replies": []}]),
        (2, None, None, []),
        (3, "z", {"name": "Bo", "tags": ["t"]}, [{"title": f"r{i}", "author": {"name": "Cy", "tags": None}, "replies": None} for i in range(4)]),
    ]
    made = spark.createDataFrame(rows, kind)
    tops, ops = nested.written(made, ["k"], POST, 1000)
    taken = sorted(r["op"] for r in ops.collect())
    assert len(set(taken)) == len(taken) and taken[0] > 1000
    assert all(r["op"] > r["object"] and (r["ref"] is None or r["ref"] == r["op"] + 1) for r in ops.collect())
    read = {r["object"]: r.asDict(True) for r in nested.read(ops, tops, POST).collect()}
    named = {r["k"]: read[r["object"]] for r in tops.collect()}

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if k not in ("object", "status")} if x.get("status", "ok") == "ok" else None
        return [bare(v) for v in x] if isinstance(x, list) else x

    assert bare(named[3]["author"]) == {"name": "Bo", "tags": ["t"]} and [bare(r)["author"]["name"] for r in named[3]["replies"]] == ["Cy"] * 4
    assert named[2]["status"] == "missing"  # an object without a field has no op
    one = bare(named[1])
    assert one["title"] == "a" and one["author"] == {"name": "Ada", "tags": ["x", "y"]}
    assert one["replies"][0]["replies"][0] == {"title": "c", "best": "1"} and one["replies"][0]["author"] is None
    assert spark.createDataFrame([], kind).select(F.lit(1)).count() == 0 and nested.written(made.limit(0), ["k"], POST, 0)[1].collect() == []


def test_an_object_over_many_batches_is_read_as_one(spark):
    """Ops of one object come in several batches to its task, with values that only an earlier or a later batch tells."""
    many = spark.range(0, 25_000, 1, 3).selectExpr("id % 3 AS object", "CASE WHEN id % 2 = 0 THEN 'title' WHEN id % 2500 = 1 THEN 'tags' ELSE 'best' END AS field", "id AS op", "CASE WHEN id = 24998 THEN NULL ELSE lpad(CAST(id * 7919 % 25000 AS STRING), 5, '0') END AS value", "CAST(NULL AS BIGINT) AS ref")
    kind = Object({"title": "lww", "tags": "set", "best": "max"})
    rows = [tuple(r) for r in many.collect()]
    got = {r["object"]: r.asDict(True) for r in nested.read(many, spark.range(4).toDF("object"), kind).collect()}
    assert got == {o: plain(rows, o, kind) for o in range(4)}


def test_the_log_meets_all_levels_at_once(spark):
    """Going down a level reads references only; however deep the type, values and links are read once each."""
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        reads.add(1)
        yield from batches

    rows = [(i, f, 10 * i + n, v, r) for i in range(1, 5) for n, (f, v, r) in enumerate((("name", f"n{i}", None), ("next", None, i + 1)))]
    log = spark.createDataFrame(rows, LOG).coalesce(1).mapInArrow(seen, LOG)
    kind = Object({"name": "lww"})
    for _ in range(3):
        kind = Object({"name": "lww", "next": kind})
    got = nested.read(log, spark.range(1, 2).toDF("object"), kind).first()
    assert got["next"]["next"]["next"]["name"] == "n4"
    assert reads.value == 2
