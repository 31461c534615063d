"""Versioned documents and typed objects."""

import pytest

from tidelog.operators import documents, reducers, schema
from tidelog.operators.schema import Field, Struct


def reduce(rows):
    return reducers.lww(rows, ["document", "field"], "op", ["value"])


ROWS = [(1, 1, "a", 1, "x"), (1, 1, "b", 2, "y"), (1, 2, "a", 3, "z"), (2, 1, "a", 1, "q"), (3, 7, "a", 1, None), (3, 8, "a", 1, None)]


def test_versions_merge_and_compact(spark, tmp_path):
    path = str(tmp_path)
    documents.save(spark.createDataFrame(ROWS, "document long, version long, field string, op long, value string"), path)
    before = sorted(map(tuple, documents.loaded(spark, path, reduce).collect()))
    assert before == [(1, "a", 3, "z"), (1, "b", 2, "y"), (2, "a", 1, "q"), (3, "a", 1, None)]
    documents.compact(spark, path, reduce)
    assert sorted(map(tuple, documents.listed(spark, path).collect())) == [(1, 1, 3), (2, 1, 1), (3, 1, 9)]
    assert sorted(map(tuple, documents.loaded(spark, path, reduce).collect())) == before
    documents.compact(spark, path, reduce)
    assert sorted(map(tuple, documents.listed(spark, path).collect())) == [(1, 1, 3), (2, 1, 1), (3, 1, 9)]
    documents.rename(spark, path, 2, 5)
    assert sorted(r["document"] for r in documents.listed(spark, path).collect()) == [1, 3, 5]
    with pytest.raises(ValueError, match="exists"):
        documents.rename(spark, path, 1, 5)


SCHEMA = "document long, version long, field string, op long, value string"


def fields(spark, path):
    return sorted(map(tuple, documents.loaded(spark, path, reduce).collect()))


@pytest.mark.parametrize("number", [1, 2, 3])
def test_what_is_saved_while_a_document_is_compacted_stays(spark, tmp_path, number):
    """Another writer saves between reading and saving, under a number that is being dropped or made."""
    path = str(tmp_path)
    documents.save(spark.createDataFrame(ROWS, SCHEMA), path)
    wrote = []

    def slow(rows):
        if not wrote:
            wrote.append(documents.save(spark.createDataFrame([(1, number, "c", 9, "late")], SCHEMA), path))
        return reduce(rows)

    documents.compact(spark, path, slow)
    want = [(1, "a", 3, "z"), (1, "b", 2, "y"), (1, "c", 9, "late"), (2, "a", 1, "q"), (3, "a", 1, None)]
    assert fields(spark, path) == want
    documents.compact(spark, path, reduce)
    assert fields(spark, path) == want and {r["versions"] for r in documents.listed(spark, path).collect()} == {1}
    documents.drop(spark.createDataFrame([(2, 1), (2, 1), (77, 1)], "document long, version long"), path)
    assert [x[0] for x in fields(spark, path)] == [1, 1, 1, 3]


def test_names_that_are_taken_meanwhile(spark, tmp_path, monkeypatch):
    path, real, wrote = str(tmp_path), documents.save, []
    documents.save(spark.createDataFrame(ROWS, SCHEMA), path)

    def between(versions, at, doc):
        mark = real(versions, at)
        if not wrote:
            wrote.append(real(spark.createDataFrame([(doc, 5, "n", 9, "late")], SCHEMA), at))
        return mark

    monkeypatch.setattr(documents, "save", lambda v, at: between(v, at, 8))
    with pytest.raises(ValueError, match="8 exists"):
        documents.rename(spark, path, 2, 8)
    assert [x for x in fields(spark, path) if x[0] in (2, 8)] == [(2, "a", 1, "q"), (8, "n", 9, "late")]
    wrote.clear()
    monkeypatch.setattr(documents, "save", lambda v, at: between(v, at, 2))
    documents.rename(spark, path, 2, 6)  # what is saved under the old name meanwhile moves too
    assert [x for x in fields(spark, path) if x[0] in (2, 6)] == [(6, "a", 1, "q"), (6, "n", 9, "late")]


@pytest.mark.parametrize(
    "kind, f, why",
    [
        ("set", Field("x", "String", "max"), "integer or float"),
        ("set", Field("x", "String", "merge"), "do not merge"),
        ("set", Field("x", "RgaString", "lww"), "not safe"),
        ("set", Field("x", "Nothing"), "unknown type"),
        ("set", Field("x", "Integer", "sum"), "unknown strategy"),
        ("lww", Field("x", "Integer", "max"), "strategy lww"),
    ],
)
def test_bad_fields_are_told(kind, f, why):
    with pytest.raises(ValueError, match=why):
        Struct("S", kind, (f,))


def test_typed_view(spark):
    s = Struct(
        "S",
        "set",
        (Field("n", "Integer", "max"), Field("last", "Count", "lww"), Field("all", "Float", "set"), Field("color", "Color"), Field("ref", "RgaString", "merge")),
        prefix="s",
        title=True,
        aliases={"Count": "Integer"},
        enums={"Color": ("red", "blue")},
    )
    rows = [(1, "n", 1, "9"), (1, "n", 2, "10"), (1, "n", 3, "none"), (1, "last", 4, "7"), (1, "last", 5, "x"), (1, "all", 6, "1.5"), (1, "all", 7, "0.5"), (1, "color", 8, "red"), (1, "ref", 9, "b"), (1, "ref", 10, "a"), (2, "color", 1, "green"), (2, "other", 2, None)]
    got = {r[0]: tuple(r)[1:] for r in schema.view(spark.createDataFrame(rows, "object long, field string, op long, value string"), s).collect()}
    assert got == {1: (10, None, [1.5, 0.5], "red", "a"), 2: (None, None, [], None, None)}
    assert [s.column(f) for f in s.fields] == ["sN", "sLast", "sAll", "sColor", "sRef"]


def rows(*fields):
    return [dict(zip(("struct", "kind", "field", "type", "strategy"), f)) for f in fields]


def test_declarations_from_a_table():
    made = schema.declared(rows(("A", "set", "x", "N", "max"), ("B", "lww", "a", "Owner", None), ("A", "set", "b", "B", "merge")), {"N": "M", "M": "Integer", "Owner": "A"})
    assert [f.name for f in made["A"].fields] == ["x", "b"] and made["A"].resolved("N") == "Integer" and made["B"].resolved("Owner") == "A"


@pytest.mark.parametrize(
    "fields, aliases, why",
    [
        (rows(("A", "set", "x", "N", "lww")), {"N": "M", "M": "N"}, "circle"),
        (rows(("A", "set", "x", "String", "lww"), ("A", "lww", "y", "String", "lww")), {}, "two ways"),
        (rows(("A", "set", "x", "String", "lww")), {"A": "String"}, "twice"),
        (rows(("A", "set", "x", "String", "lww"), ("A", "set", "x", "String", "lww")), {}, "twice"),
        (rows(("A", "set", "x", "Other", "lww")), {}, "unknown type"),
    ],
)
def test_bad_declarations_are_told(fields, aliases, why):
    with pytest.raises(ValueError, match=why):
        schema.declared(fields, aliases)


def test_fields_that_merge_are_read_by_their_type(spark):
    types = schema.declared(rows(("A", "set", "b", "B", "merge"), ("A", "set", "n", "Integer", "min"), ("B", "set", "v", "Integer", "max"), ("B", "set", "w", "String", "set"), ("B", "set", "c", "A", "merge")))
    state = [(1, "b", 1, "20"), (1, "b", 2, "10"), (1, "b", 3, "none"), (1, "n", 4, "5"), (2, "b", 5, "99"), (3, "n", 6, "x"), (10, "v", 7, "1"), (10, "w", 8, "p"), (20, "v", 9, "7"), (20, "w", 10, "q"), (20, "c", 11, "1")]
    roots = spark.createDataFrame([(1,), (2,), (3,), (1,)], "object long")
    got = {r["object"]: r.asDict(True) for r in schema.read(spark.createDataFrame(state, "object long, field string, op long, value string"), roots, "A", types).collect()}
    assert got[1] == {"object": 1, "b": {"object": 10, "v": 7, "w": ["p", "q"], "c": "1"}, "n": 5}
    assert got[2] == {"object": 2, "b": None, "n": None} and got[3] == {"object": 3, "b": None, "n": None}
