"""A stream of a folder store's names: the driver holds none of them, and old files are told as well as new ones."""

import os
import pickle

from pyspark.sql import functions as F

from tidelog.sources import filestore, folders


def test_the_driver_holds_no_name(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("object"), F.lit("p").alias("patch"), F.lit("x").alias("text"))
    filestore.saved(rows, str(tmp_path), folders.LOG)
    reader = filestore.FolderStream(str(tmp_path), list(folders.LOG), 4)
    plan = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(plan) == 4 and len(pickle.dumps(plan)) < 1000
    told = [[x[:2] for x in reader.read(p)] for p in plan]
    assert sorted(sum(told, [])) == sorted((f"d{i}", "p") for i in range(200)) and all(told)
    assert "FileStreamSource" not in folders.updates(spark, str(tmp_path), folders.LOG)._jdf.queryExecution().toString()


def test_files_of_any_age_are_told_once(spark, tmp_path):
    path, place = f"{tmp_path}/store", f"{tmp_path}/place"

    def run():
        got = []
        folders.updates(spark, path, folders.DOCUMENTS).writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(lambda x, n: got.extend(map(tuple, x.collect()))).start().awaitTermination()
        return sorted(got)

    def save(*names):
        filestore.saved(spark.createDataFrame([("c", d, "v 1", "x") for d in names], "collection string, document string, version string, text string"), path, folders.DOCUMENTS)

    assert run() == []
    save("a", "b")
    assert run() == [("c", "a", "v 1"), ("c", "b", "v 1")]
    save("old", "a")  # a is written again, and has been told
    for top, _, files in os.walk(f"{path}/c/old"):
        for f in files:
            os.utime(f"{top}/{f}", (0, 0))
    assert run() == [("c", "old", "v 1")]
    assert run() == []
