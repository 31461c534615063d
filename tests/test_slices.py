"""Python workers take a few objects of a batch at a time, however many rows it has."""

import pyarrow as pa

from tidelog.operators import differences, lists, sequences
from tidelog.shared import FEW


def test_edits_and_orders_come_in_slices():
    n = 3 * FEW + 5
    strings, longs = pa.list_(pa.string()), pa.list_(pa.int64())
    edits = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([[1, 2]] * n, longs), pa.array([["a", "b"]] * n, strings), pa.array([["a", "c"]] * n, strings)], ["object", "ops", "old", "new"])
    got = list(differences._small(iter([edits])))
    assert len(got) == 4 and sorted(r["object"] for b in got for r in b.to_pylist()) == sorted([*range(n)] * 2)
    trees = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64()), pa.array([[k + 1, k + 2] for k in range(n)], longs), pa.array([[0, k + 1] for k in range(n)], longs)], ["object", "ops", "parents"])
    got = list(sequences._orders(iter([trees])))
    assert len(got) == 4 and [r["ops"] for b in got for r in b.to_pylist()] == [[k + 1, k + 2] for k in range(n)]
