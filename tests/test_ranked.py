"""List ranking in rounds that drop steps: the same order as in one task, and tables that a few times the nodes fill."""

import random

import pytest

from tidelog.operators import sequences


def walked(rows):
    below = {}
    for o, op, p in rows:
        below.setdefault((o, p), []).append(op)
    out, nodes = [], {(o, op) for o, op, _ in rows}
    for o, root in {(o, p) for o, _, p in rows if (o, p) not in nodes}:
        stack, pos = sorted(below[o, root]), 0
        while stack:
            op = stack.pop()
            out.append((o, root, op, pos))
            pos += 1
            stack += sorted(below.get((o, op), ()))
    return sorted(out)


def test_rounds_have_the_order_of_a_walk(spark, monkeypatch):
    r = random.Random(3)
    rows = [(0, i, i - 1) for i in range(1, 400)] + [(1, i, r.randrange(i)) for i in range(1, 400)] + [(2, 5 * i, -i) for i in range(1, 20)]
    nodes = spark.createDataFrame(rows, "object long, op long, parent long")
    written, kept = [], sequences.kept

    def counted(x):
        out = kept(x)
        written.append(out.count())
        return out

    monkeypatch.setattr(sequences, "kept", counted)
    got = sequences._ranked(nodes, local=50)
    assert sorted(map(tuple, got.select("object", "root", "op", "pos").collect())) == walked(rows)
    assert len(written) > 10 and sum(written) < 20 * len(rows)


def test_a_circle_is_told(spark):
    steps = spark.createDataFrame([(0, 2, 1), (2, 0, 1), (4, -1, 1)], "at long, to long, n long")
    with pytest.raises(Exception, match="cycle"):
        sequences._distances(steps, 100).collect()
