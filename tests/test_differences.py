"""Edits by differences, as few as there can be on small lists and the same result on large ones; running values over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import differences, scans


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_is_longest():
    r = random.Random(1)
    for _ in range(600):
        a, b = ([r.choice("abcd"[: r.randint(1, 4)]) for _ in range(r.randrange(14))] for _ in "ab")
        pairs = differences.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_heaviest_run_order():
    r = random.Random(2)
    for _ in range(500):
        sizes = [r.randint(1, 5) for _ in range(r.randrange(9))]
        deal = list(range(len(sizes)))
        r.shuffle(deal)
        starts, at = [0] * len(sizes), 0
        for k in deal:
            starts[k], at = at, at + sizes[k]
        best = 0
        for m in range(1 << len(sizes)):
            some = [k for k in range(len(sizes)) if m >> k & 1]
            if all(starts[x] < starts[y] for x, y in zip(some, some[1:])):
                best = max(best, sum(sizes[k] for k in some))
        got = differences.heaviest(starts, sizes)
        assert all(starts[x] < starts[y] for x, y in zip(got, got[1:])) and sum(sizes[k] for k in got) == best


def applied(old, ops):
    """old, (op, value) in order, with ops (op, ref, value) applied one by one."""
    out = list(old)
    for op, ref, value in sorted(x for x in ops if x[2] is not None):
        at = [o for o, _ in out].index(ref) + 1 if ref else 0
        out.insert(at, (op, value))
    gone = {ref for _, ref, value in ops if value is None}
    return [v for o, v in out if o not in gone]


def tables(spark, old, new):
    cells = lambda d: [(o, i * 3, 10 * i + 10, c) for o, v in d.items() for i, c in enumerate(v)]
    schema = "object long, pos long, op long, value string"
    return spark.createDataFrame(cells(old), schema), spark.createDataFrame(cells(new), schema).drop("op")


def edits(spark, old, new, **options):
    got = {o: [] for o in {*old, *new}}
    for x in differences.edited(*tables(spark, old, new), F.lit(10**9).cast("long"), **options).collect():
        got[x["object"]].append((x["op"], x["ref"], x["value"]))
    return got


def shaken(r, lines):
    """Some lines changed, taken out, put in, said twice; a part moved."""
    out = []
    for x in lines:
        out += r.choice([[x]] * 12 + [[], [x, x], [x + "!"], [f"new {r.random()}", x]])
    if len(out) > 9:
        a, b = sorted(r.sample(range(len(out)), 2))
        part, out = out[a:b], out[:a] + out[b:]
        at = r.randrange(len(out) + 1)
        out = out[:at] + part + out[at:]
    return out


def test_small_edits_are_minimal(spark):
    r = random.Random(3)
    old = {o: [r.choice("abcd") for _ in range(r.randrange(12))] for o in range(60)}
    new = {o: [r.choice("abcd") for _ in range(r.randrange(12))] if o % 4 else v for o, v in old.items()}
    old[100], new[101] = list("abc"), list("xy")
    for o, ops in edits(spark, old, new).items():
        a, b = old.get(o, []), new.get(o, [])
        assert applied([(10 * i + 10, v) for i, v in enumerate(a)], ops) == b
        assert len(ops) == len(a) + len(b) - 2 * longest(a, b)


@pytest.mark.parametrize("most,most_runs", [(5, 10**6), (40, 2)])
def test_large_lists_by_joins(spark, most, most_runs):
    r = random.Random(most)
    old = {o: [f"line {r.randrange(10 ** r.randint(1, 4))}" for _ in range(n)] for o, n in enumerate([3, 30, 200, 300, 400])}
    new = {o: shaken(r, v) for o, v in old.items()}
    old[9], new[9] = ["x"] * 90, ["x"] * 60 + ["y"] * 20  # nothing that occurs once
    old[10], new[11] = [str(i) for i in range(50)], [str(i) for i in range(50)]
    old[12] = new[12] = [str(i) for i in range(60)]
    for o, ops in edits(spark, old, new, most=most, most_runs=most_runs).items():
        a, b = old.get(o, []), new.get(o, [])
        assert applied([(10 * i + 10, v) for i, v in enumerate(a)], ops) == b, o
        if o in (2, 3, 4) and most_runs > 2:
            assert len(ops) <= 1.5 * (len(a) + len(b) - 2 * longest(a, b)) + 10
    assert edits(spark, {12: old[12]}, {12: new[12]}, most=most) == {12: []}


def test_no_lists_to_edit(spark):
    assert edits(spark, {}, {}) == {}


def test_scanned_over_many_ranges(spark):
    r = random.Random(4)
    rows = [(k, i, r.choice([None, r.randrange(100)])) for k, n in ((0, 500), (1, 3), (2, 200), (3, 1)) for i in range(n)]
    r.shuffle(rows)
    x = spark.createDataFrame(rows, "k long, i long, v long")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.scanned(x, ["k"], ["i"], sums={"total": F.coalesce("v", F.lit(0))}, lasts={"seen": F.col("v")}, before={"prior": F.col("v")}).collect()
        parts = scans.dealt(x, ["k"], ["i"]).select("k", "_part").distinct().where("k = 0").count()
        text = scans.smaller_before(x.selectExpr("CAST(k AS STRING) AS k", "i", "i * 7919 % 1009 AS w", "v"), "k", "i", "w", "s").collect()
        falls = scans.smaller_before(x.selectExpr("k", "i", "CASE WHEN i = 3 THEN -1 ELSE 1000 - i END AS w"), "k", "i", "w", "s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 3
    want, state = {}, {}
    for k, i, v in sorted(rows, key=lambda x: x[:2]):
        total, seen, prior = state.get(k, (0, None, None))
        want[k, i] = (total + (v or 0), v if v is not None else seen, prior)
        state[k] = (*want[k, i][:2], v)
    assert {(x["k"], x["i"]): (x["total"], x["seen"], x["prior"]) for x in got} == want
    for rows in (text, falls):
        by = {}
        for x in sorted(rows, key=lambda x: (x["k"], x["i"])):
            before = by.setdefault(x["k"], [])
            assert x["s"] == next((w for w in reversed(before) if w < x["w"]), None)
            before.append(x["w"])
