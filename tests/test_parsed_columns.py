"""Pieces of text as columns: what is no piece, and what is spread over tasks."""

from pyspark.sql import functions as F

from tidelog.functions import parsing
from tidelog.plans import catalog


def test_pieces_of_all_kinds_beside_broken_ones(spark):
    """Ids, payloads and ops of one column, where other rows are null, empty or broken."""
    said = ["1ABC+me", None, "", "=5 'a' >1ABC+me", "*lww#x@5+a:6+b 1;", "@5+a:6+b =2,", "1ABC+me]]", "^1.5"]
    x = spark.createDataFrame(list(enumerate(said)), "k int, t string").coalesce(1)
    got = x.select("k", parsing.parse_uuid("t").alias("u"), parsing.parse_payload("t").alias("p"), parsing.parse_op("t").alias("o"), parsing.parse_open_op("t").alias("w")).orderBy("k").collect()
    assert [r["k"] for r in got if r["u"]] == [0]
    assert [r["p"] and [a["tag"] for a in r["p"]] for r in got] == [["uuid"], None, [], ["integer", "string", "uuid"], None, None, None, ["float"]]
    assert got[3]["p"][2]["u"] == got[0]["u"]
    assert got[4]["o"]["payload"][0]["i"] == 1 and got[5]["w"]["payload"][0]["i"] == 2
    assert got[1]["o"] is None and got[2]["o"] is None and got[1]["w"] is None and got[4]["w"] is None
    assert got[4]["o"]["op_id"]["value"] == got[5]["w"]["op_id"]["value"] > 0
    after = x.where("k = 0").select(parsing.parse_uuid_atom(F.lit(None).cast(x.select(parsing.parse_uuid("t")).schema[0].dataType), F.col("t")).alias("u")).first()["u"]
    assert after == got[0]["u"]


def test_one_file_is_parsed_by_many_tasks(spark):
    """A file of few splits is no reason to parse all its rows in one task."""
    parts = catalog.QUERIES["parsed_pieces"](spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == spark.sparkContext.defaultParallelism > 1
