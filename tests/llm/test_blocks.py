"""Blocks of a family in the Jaccard join."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidelog.llm import jaccard


@pytest.mark.parametrize("ranges", [1, 40])
def test_blocks_do_not_depend_on_ranges(spark, ranges):
    """A family of 1,000 sets beside small ones has as many blocks however many tasks it is dealt to; a repeated set comes once."""
    conf = {"spark.sql.shuffle.partitions": str(ranges), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        x = spark.range(1050).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).cast("long").alias("family"), (F.col("id") % 90 + 1).alias("n"), F.array_repeat((F.col("id") % 5).cast("int"), jaccard.COUNTS).alias("point"), "id", F.col("id").alias("s1"), F.col("id").alias("s2"))
        got = jaccard._placed(x.union(x.where("id % 3 = 0")), 100, 10_000).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(r["id"] for r in got) == list(range(1050))
    assert len({r["block"] for r in got if r["family"] == 7}) == 10
    assert all(n <= 100 for n in Counter(r["block"] for r in got).values())
    assert len({(r["family"], r["block"]) for r in got}) == len({r["block"] for r in got}) == 60
    large = sorted((r["n"], list(r["point"]), r["id"], r["block"]) for r in got if r["family"] == 7)
    assert [b for *_, b in large] == sorted(b for *_, b in large)
