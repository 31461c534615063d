"""Order of trees: the walk and the ranking by joins agree, and hold orphans, repeats and nulls."""

import random

from pyspark.sql import functions as F

from tidelog.operators import lists, sequences
from tidelog.sources import text


def tree(seed, n):
    r = random.Random(seed)
    return [(seed, i, r.randrange(max(0, i - r.choice([1, 2, 50])), i)) for i in range(1, n)]


def test_ranking_is_the_walk(spark):
    rows = [x for s, n in enumerate([2, 3, 40, 150, 400], 1) for x in tree(s, n)]
    rows += [(9, 5, 4), (9, 6, 5), (9, 7, 0), (9, 7, 0), (None, 1, 0), (9, None, 0), (9, 8, None)]  # orphans, repeats, nulls
    log = spark.createDataFrame(rows, "object long, op long, parent long")
    walked = sorted(map(tuple, sequences.tree_order(log).collect()))
    ranked = sorted(map(tuple, sequences.tree_order(log, local=100).collect()))
    assert walked == ranked
    assert [x for x in walked if x[0] == 9] == [(9, 7, 0)]
    assert sorted(p for o, _, p in walked if o == 5) == list(range(399))


def zipped(a, b):
    """Two lists as one: equal heads unify, otherwise the greater id goes first; each id once."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        out.append(max(x, y))
        i, j = i + (x >= y), j + (y >= x)
    return list(dict.fromkeys(out + a[i:] + b[j:]))


def plain(found, zero):
    """Lists (ref, ops) zipped until nothing can be placed any more: those of one reference, then each after the id it stands after."""
    state: dict = {}
    for ref, ops in found:
        state[ref] = zipped(state.get(ref, []), ops)
    while True:
        at = next(((r, into) for r in state for into in state if r != zero and r != into and r in state[into]), None)
        if at is None:
            return state
        ref, into = at
        place = state[into].index(ref) + 1
        state[into] = state[into][:place] + zipped(state[into][place:], state.pop(ref))


def history(r, n, replicas=3):
    """(final order, lists, removals) of a list that several writers grow and send to each other in part: whole states, runs as patches, raw inserts."""
    known, clock, parent, sent, removals = [[] for _ in range(replicas)], 0, {}, [], []
    for _ in range(n):
        w = r.randrange(replicas)
        have = known[w]
        at = r.choice([0, *have]) if r.random() < 0.7 or not have else have[-1]
        run = []
        for _ in range(r.choice([1, 1, 2, 5])):
            clock += r.randint(1, 3)
            parent[clock] = run[-1] if run else at
            run.append(clock)
        have += run
        sent.append((at, run))
        if have and r.random() < 0.3:
            clock += 1
            removals.append((r.choice(have), clock))
        if r.random() < 0.4:
            a, b = r.sample(range(replicas), 2)
            known[b] = sorted(set(known[a]) | set(known[b]))

    def order(ops):
        below = {}
        for o in sorted(ops):
            below.setdefault(parent[o], []).append(o)
        out, stack = [], list(below.get(0, []))
        while stack:
            out.append(stack.pop())
            stack += below.get(out[-1], [])
        return out

    lists = [(0, order(k)) for k in known] + [x for x in sent if r.random() < 0.8] + [(parent[o], [o]) for _, run in sent for o in run if r.random() < 0.2]
    r.shuffle(lists)
    return order(parent), lists, removals


def test_forest_is_the_zip_of_lists():
    r = random.Random(6)
    for _ in range(400):
        _, found, _ = history(r, r.randint(1, 12))
        found = [x for x in found if x[0] or r.random() < 0.5]
        assert lists.forest(found) == {k: v for k, v in plain(found, 0).items() if v}


def test_forest_of_all_is_the_history():
    r = random.Random(7)
    for _ in range(100):
        whole, found, _ = history(r, 10)
        assert lists.forest([*found, (0, whole[:1])] if whole else found).get(0, []) == [o for o in whole if any(o in ops for _, ops in found)]


def test_forest_of_odd_references():
    assert lists.forest([(0, [1, 5, 3]), (5, [2])]) == {0: [1, 5, 3, 2]}  # a greater reference is no place of its own
    assert lists.forest([(2, [1]), (1, [2])]) == {1: [2]}  # a circle
    assert lists.forest([(9, [4, 8]), (9, [6])]) == {9: [6, 4, 8]}
    assert lists.forest([(0, [])]) == {}


def as_tables(spark, histories):
    rows = [(obj, n, ref, i, o, 0, f"v{o}") for obj, (_, found, _) in histories.items() for n, (ref, ops) in enumerate(found) for i, o in enumerate(ops)]
    gone = [(obj, t, at) for obj, (_, _, removals) in histories.items() for t, at in removals]
    return spark.createDataFrame(rows, "object long, chunk long, ref long, pos long, op long, gone long, payload string"), spark.createDataFrame(gone, "object long, target long, tombstone long")


def test_reduced_by_tasks_and_by_joins(spark):
    r = random.Random(8)
    histories = {k: history(r, n) for k, n in enumerate([1, 3, 10, 30, 90, 200])}
    for k, (whole, found, removals) in histories.items():
        histories[k] = (whole, [x for x in found if x[0] or k % 2], removals)  # where no state came, patches wait
    vertices, removals = as_tables(spark, histories)
    got = {}
    for local in (10**9, 60, 0):
        rows, waiting = lists.reduced(vertices, removals, 0, local=local)
        got[local] = sorted(map(tuple, rows.collect())), sorted(map(tuple, waiting.collect()))
    assert got[10**9] == got[60] == got[0]
    for k, (_, found, gone) in histories.items():
        want = {ref: ops for ref, ops in plain(found, 0).items() if ops}
        mine = [x for x in got[0][0] if x[0] == k]
        assert {ref: [x[3] for x in sorted(mine, key=lambda x: x[2]) if x[1] == ref] for ref in {x[1] for x in mine}} == want
        there = {o for ops in want.values() for o in ops}
        latest = {t: max(at for u, at in gone if u == t) for t, _ in gone}
        assert {x[3]: x[4] for x in mine} == {o: latest.get(o, 0) for o in there}
        assert [x for x in got[0][1] if x[0] == k] == sorted((k, t, at) for t, at in latest.items() if t not in there)


def test_joins_take_odd_references_alike(spark):
    found = {0: [(0, [1, 5, 3]), (5, [2]), (3, [2])], 1: [(2, [1]), (1, [2]), (2, [7])], 2: [(9, [4, 8]), (9, [6])], 3: [(50 - i, [49 - i]) for i in range(40)]}
    vertices, removals = as_tables(spark, {k: (None, v, []) for k, v in found.items()})
    none = spark.createDataFrame([], "object long, target long, tombstone long")
    a, b = (sorted(map(tuple, lists.reduced(vertices, none, 0, local=n)[0].collect())) for n in (10**9, 0))
    assert a == b and len(a) > 40


def test_log_of_all_kinds_of_parts(spark):
    """The same histories written as states, patches, removals and raw ops of a text log, and reduced."""
    r = random.Random(9)
    said, want = [], []
    for k in range(12):
        _, found, removals = history(r, 8)
        parts = []
        for ref, ops in found:
            if not ops:
                continue
            head = f"*rga#c{k:02d}@{ids10(max(ops))}:{ids10(ref) if ref else '0'}"
            if ref and len(ops) == 1 and r.random() < 0.5:
                parts.append(f"*rga#c{k:02d}@{ids10(ops[0])}:{ids10(ref)}'v{ops[0]}';")
            else:
                parts.append(f"{head}! " + " ".join(f"@{ids10(o)}:0'v{o}'" for o in ops))
        parts += [f"*rga#c{k:02d}@{ids10(at)}:{ids10(t)};" for t, at in removals]
        said.append(" ".join(parts))
        want.append((found, removals))
    log = text.parsed_log(spark.createDataFrame([("\n.\n".join(said),)], "text string"))
    assert log.where("error IS NOT NULL").isEmpty()
    rows, waiting = lists.reduced(*lists.from_log(log))
    short = lambda s: int(s[1:11]) if s != lists.ZERO else 0
    got = [{} for _ in want]
    for x in sorted(rows.collect(), key=lambda x: x["pos"]):
        got[int(x["object"][2:4])].setdefault(short(x["ref"]), []).append((short(x["op"]), short(x["gone"])))
    for k, (found, removals) in enumerate(want):
        latest = {t: max(at for u, at in removals if u == t) for t, _ in removals}
        assert got[k] == {ref: [(o, latest.get(o, 0)) for o in ops] for ref, ops in plain(found, 0).items() if ops}
    assert waiting.isEmpty() or all(short(x["target"]) for x in waiting.collect())


def ids10(n):
    """An id of ten letters whose order is the number's."""
    return f"{n:010d}"


def test_edits_give_the_wanted_list(spark):
    r = random.Random(4)
    old = {o: [r.choice("abcd") for _ in range(r.randrange(12))] for o in range(30)}
    new = {o: [r.choice("abcd") for _ in range(r.randrange(12))] if o % 3 else v for o, v in old.items()}
    cells = lambda d: [(o, i, 10 * i + 10, c) for o, v in d.items() for i, c in enumerate(v)]
    schema = "object long, pos int, op long, value string"
    current, wanted = spark.createDataFrame(cells(old), schema), spark.createDataFrame(cells(new), schema).drop("op")
    ops = lists.edited(current, wanted, F.lit(1000).cast("long"))
    assert {x["object"] for x in ops.select("object").distinct().collect()} <= {o for o in old if old[o] != new[o]}
    zero = F.lit(0).cast("long")
    states = current.select("object", zero.alias("chunk"), zero.alias("ref"), F.col("pos").cast("long").alias("pos"), "op", zero.alias("gone"), "value")
    inserts = ops.where("value IS NOT NULL").select("object", F.col("op").alias("chunk"), "ref", zero.alias("pos"), "op", zero.alias("gone"), "value")
    removals = ops.where("value IS NULL").selectExpr("object", "ref AS target", "op AS tombstone")
    rows, waiting = lists.reduced(states.unionByName(inserts).withColumnRenamed("value", "payload"), removals, 0)
    assert waiting.isEmpty()
    got = {o: [] for o in old}
    for x in sorted(rows.where("gone = 0").collect(), key=lambda x: x["pos"]):
        assert x["ref"] == 0
        got[x["object"]].append(x["payload"])
    assert got == new


def test_no_lists(spark):
    log = text.parsed_log(spark.createDataFrame([("*lww#x@1:a 5;",)], "text string"))
    rows, waiting = lists.reduced(*lists.from_log(log))
    assert rows.isEmpty() and waiting.isEmpty()
