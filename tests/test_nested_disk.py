"""Nested objects: an object's ops are reduced before they are dealt out."""

import json

from pyspark.sql import functions as F

from tidelog.operators import nested
from tidelog.operators.nested import Object


def test_ops_are_reduced_before_they_are_dealt_out(spark, tmp_path):
    """Objects of a hundred ops each send a row a task to the join, not their ops; objects in themselves and missing ones are as before."""
    x = spark.range(50).select(F.col("id").alias("object"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100).cast("long"))).alias("op"))
    log = x.select("object", F.lit("name").alias("field"), "op", F.concat(F.lit("v"), F.col("op").cast("string")).alias("value"), F.lit(None).cast("long").alias("ref"))
    refs = spark.range(50).select(F.col("id").alias("object"), F.lit("next").alias("field"), F.lit(101).cast("long").alias("op"), F.lit(None).cast("string").alias("value"), F.when(F.col("id") % 3 > 0, F.col("id") + F.col("id") % 3 - 1).otherwise(F.lit(1000)).alias("ref"))
    plans, kept = [], nested.kept

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    nested.kept = seen
    try:
        got = nested.read(log.unionByName(refs), spark.range(50).toDF("object"), Object({"name": "lww", "next": Object({"name": "lww"})})).collect()
    finally:
        nested.kept = kept
    want = lambda o: {0: {"object": 1000, "status": "missing", "name": None}, 1: {"object": o, "status": "cycle", "name": None}, 2: {"object": o + 1, "status": "ok", "name": "v100"}}[o % 3]
    want_of = {o: want(o) if o < 49 or o % 3 < 2 else {"object": 50, "status": "missing", "name": None} for o in range(50)}
    assert {r["object"]: json.loads(json.dumps(r["next"].asDict())) for r in got} == want_of
    assert {r["name"] for r in got} == {"v100"}
    assert "LeftSemi" not in plans[-1] and "partial_max" in plans[-1]
