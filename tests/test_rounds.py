"""Rounds of a loop: a table kept between them has the same rows, and its plan knows nothing of earlier rounds."""

from tidelog.operators import sequences
from tidelog.shared import kept, shared_dir


def known(x):
    return x._jdf.queryExecution().optimizedPlan().constraints().size()


def test_kept_tables_carry_no_constraints(spark):
    shared_dir(spark)
    x = spark.createDataFrame([(0, i, i - 1) for i in range(1, 50)], "object long, op long, parent long").where("op <> parent")
    assert known(x.checkpoint()) > 0
    assert known(kept(x)) == 0 and sorted(kept(x).collect()) == sorted(x.collect())


def test_a_long_chain_is_ranked(spark):
    n = 300
    nodes = spark.createDataFrame([(0, i, i - 1) for i in range(1, n + 1)], "object long, op long, parent long").where("op <> parent")
    assert sorted((r["op"], r["pos"], r["root"]) for r in sequences._ranked(nodes).collect()) == [(i, i - 1, 0) for i in range(1, n + 1)]
