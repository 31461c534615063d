"""Listing a store of few large folders is shared by tasks; each file is told once."""

from pyspark.sql import functions as F

from tidelog.sources import filestore, folders


def test_a_large_folder_is_listed_by_several_tasks(spark, tmp_path):
    path = str(tmp_path)
    rows = spark.range(300).select(F.lit("c").alias("collection"), F.concat(F.lit("d"), F.col("id").cast("string")).alias("document"), F.explode(F.array(F.lit("v"), F.lit("w"))).alias("version"), F.lit("x").alias("text"))
    filestore.saved(rows, path, folders.DOCUMENTS)
    x = filestore.listed(spark, path, folders.DOCUMENTS).withColumn("part", F.spark_partition_id())
    got = x.collect()
    assert sorted((r["document"], r["version"]) for r in got) == sorted((f"d{i}", v) for i in range(300) for v in "vw")
    assert len({r["part"] for r in got}) > 1
